from datetime import datetime, timezone

import pytest

from lumisift.streaming import watch

pytest.importorskip("google.protobuf")  # state in Python processes speaks it


def at(minute):
    return datetime(2024, 1, 1, 0, minute, tzinfo=timezone.utc)


def listing(spark, *rows):
    return spark.createDataFrame([(p, n, datetime(2023, 1, m)) for p, n, m in rows], "path string, length bigint, mtime timestamp")


def run(spark, tmp_path):
    watch.index_changes(spark, str(tmp_path / "listings"), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.schema(watch.CHANGES).option("recursiveFileLookup", True).parquet(str(tmp_path / "table")).collect()
    return sorted((r["path"], r["change"], r["length"], r["seen_at"].minute) for r in rows)


def test_new_changed_and_deleted_files_over_three_triggers(spark, tmp_path):
    add = lambda minute, *rows: watch.add_listing(listing(spark, *rows), str(tmp_path / "listings"), at(minute))
    add(1, ("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("d", 4, 1))
    first = [(p, "new", n, 1) for p, n in (("a", 1), ("b", 1), ("c", 1), ("d", 4))]
    assert run(spark, tmp_path) == first
    assert run(spark, tmp_path) == first  # nothing has come: nothing changes, and a run starts from its state
    add(2, ("a", 1, 1), ("b", 2, 1), ("c", 1, 2))
    second = sorted([*first, ("b", "changed", 2, 2), ("c", "changed", 1, 2), ("d", "deleted", 4, 2)])
    assert run(spark, tmp_path) == second
    add(3, ("a", 1, 1), ("d", 5, 1), ("c", 1, 2))
    third = sorted([*second, ("b", "deleted", 2, 3), ("d", "new", 5, 3)])
    assert run(spark, tmp_path) == third
    left = {(r["path"], r["length"]) for r in watch.snapshot(spark, str(tmp_path / "table")).collect()}
    assert left == {("a", 1), ("c", 1), ("d", 5)}
    add(4)  # an empty listing
    assert [r[:2] for r in run(spark, tmp_path) if r[3] == 4] == [("a", "deleted"), ("c", "deleted"), ("d", "deleted")]
    assert watch.snapshot(spark, str(tmp_path / "table")).count() == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_folders_are_listed(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.png").write_bytes(b"1")
    (folder / "b.png").write_bytes(b"1")
    watch.list_folders(spark, [str(folder)], str(tmp_path / "listings"), "*.png", at(1))
    (folder / "a.png").unlink()
    (folder / "b.png").write_bytes(b"22")
    run(spark, tmp_path)
    watch.list_folders(spark, [str(folder)], str(tmp_path / "listings"), "*.png", at(2))
    got = [(p.rsplit("/", 1)[1], c, n) for p, c, n, _ in run(spark, tmp_path)]
    assert got == [("a.png", "deleted", 1), ("a.png", "new", 1), ("b.png", "changed", 2), ("b.png", "new", 1)]
