import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lumisift.sources import archives, files


def zips(spark, folder):
    return files.scan_files(spark, [str(folder)], "*.zip")


def test_round_trip(spark, image_tree, tmp_path):
    found = files.walk_files(spark, [str(image_tree)])
    used = archives.export_archive(found, str(image_tree), str(tmp_path / "out"), shards=3)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert used == len(names) and all(n.startswith("part-") and n.endswith(".zip") for n in names)
    got = {r["member"]: hashlib.sha256(r["content"]).hexdigest() for r in archives.import_archive(zips(spark, tmp_path / "out")).collect()}
    want = {str(p.relative_to(image_tree)): hashlib.sha256(p.read_bytes()).hexdigest()
            for p in image_tree.rglob("*") if p.is_file()}
    assert got == want


def test_single_shard_is_deflated(spark, image_tree, tmp_path):
    archives.export_archive(files.scan_files(spark, [str(image_tree)]), str(image_tree), str(tmp_path / "o"), shards=1)
    with zipfile.ZipFile(tmp_path / "o" / "part-00000.zip") as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_DEFLATED}
        assert "sub dir/b.png" in z.namelist()


def test_an_export_replaces_the_one_before(spark, image_tree, tmp_path):
    found = files.scan_files(spark, [str(image_tree)])
    archives.export_archive(found, str(image_tree), str(tmp_path / "o"), shards=4)
    archives.export_archive(found, str(image_tree), str(tmp_path / "o"), shards=1)
    assert [p.name for p in (tmp_path / "o").iterdir()] == ["part-00000.zip"]


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    found = spark.createDataFrame([("file:/gone/a.png", 1)], "path string, length bigint")
    with pytest.raises(Exception):
        archives.export_archive(found, "/gone", str(tmp_path / "o"), shards=1)
    assert list((tmp_path / "o").iterdir()) == []


def test_manifest_rules(spark):
    rows = spark.createDataFrame([("file:/x/a b.png",), ("file:/x/y/c.png",), ("file:/x/out.zip",), ("file:/x2/d.png",)], "path string")
    got = {r["path"]: r["member"] for r in archives.archive_manifest(rows, "file:/x/", "file:/x/out.zip").collect()}
    assert got == {"file:/x/a b.png": "a b.png", "file:/x/y/c.png": "y/c.png"}
    single = archives.archive_manifest(rows, "file:/x2/d.png", "file:/x2/o.zip").collect()
    assert [r["member"] for r in single] == ["d.png"]
    with pytest.raises(ValueError):
        archives.archive_manifest(rows, "file:/x", "file:/x/")


def test_output_inside_the_input_is_skipped(spark, image_tree, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    for _ in range(2):  # the second run meets the first run's archive
        archives.export_archive(files.scan_files(spark, [str(tmp_path)]), str(tmp_path), str(tmp_path / "zips"), shards=1)
    with zipfile.ZipFile(tmp_path / "zips" / "part-00000.zip") as z:
        assert z.namelist() == ["a.txt"]


def test_nothing_to_archive(spark, image_tree, tmp_path):
    with pytest.raises(FileNotFoundError):
        archives.export_archive(files.scan_files(spark, [str(image_tree)]), str(image_tree / "nowhere"), str(tmp_path))


@pytest.fixture(scope="module")
def odd_zips(tmp_path_factory):
    root = tmp_path_factory.mktemp("zips")
    with zipfile.ZipFile(root / "ok.zip", "w") as z:
        z.writestr("d/", "")
        z.writestr("d/x.txt", "hello")
        z.writestr("big.bin", b"0" * 5000)
    (root / "broken.zip").write_bytes((root / "ok.zip").read_bytes()[:60])
    with zipfile.ZipFile(root / "climb.zip", "w") as z:
        z.writestr("../x", "no")
        z.writestr("fine.txt", "yes")
    return root


def test_import_reports_trouble_per_row(spark, odd_zips):
    rows = archives.import_archive(zips(spark, odd_zips), max_bytes=1000).collect()
    got = {(r["archive"].rsplit("/", 1)[1], r["member"]): (r["content"] and bytes(r["content"]), r["error"] is None) for r in rows}
    assert got == {("ok.zip", "d/x.txt"): (b"hello", True), ("ok.zip", "big.bin"): (None, False), ("broken.zip", None): (None, False),
                   ("climb.zip", "../x"): (None, False), ("climb.zip", "fine.txt"): (b"yes", True)}


def test_extract_writes_safe_members(spark, odd_zips, tmp_path):
    out = archives.extract_archive(zips(spark, odd_zips), str(tmp_path / "new" / "dir")).collect()
    assert {r["member"] for r in out if r["error"] is None} == {"d/x.txt", "big.bin", "fine.txt"}
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == [
        "new/dir/big.bin", "new/dir/d/x.txt", "new/dir/fine.txt"]
    with pytest.raises(ValueError):
        archives.extract_archive(zips(spark, odd_zips), str(odd_zips / "ok.zip"))


def test_shards_are_stable(spark):
    rows = spark.range(100).select(F.concat(F.lit("m"), "id").alias("member"), F.lit(1).alias("length"))
    a = archives.plan_shards(rows, 4).orderBy("member").collect()
    assert a == archives.plan_shards(rows.repartition(7), 4).orderBy("member").collect()
    assert archives.plan_shards(rows.withColumn("length", F.lit(archives.SHARD_BYTES // 10))).agg(F.max("shard")).first()[0] == 9


def test_a_small_archive_is_opened_by_one_task(spark, image_tree, tmp_path, monkeypatch):
    archives.export_archive(files.scan_files(spark, [str(image_tree)]), str(image_tree), str(tmp_path / "o"), shards=4)
    placed = archives._placed(zips(spark, tmp_path / "o"), "path").select("archive", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(placed) == len({r["archive"] for r in placed})
    monkeypatch.setattr(archives, "SLICE_BYTES", 100)
    cut = archives._listed(zips(spark, tmp_path / "o"), "path").select("archive", "slice").distinct().count()
    assert cut > len(placed)


@pytest.mark.parametrize("members, held", [(8, 3), (66_000, 10_000)])  # the second needs wide fields
def test_directories_are_held_in_parts(tmp_path, monkeypatch, members, held):
    monkeypatch.setattr(archives, "DIRECTORY_ROWS", held)
    with open(tmp_path / "a.zip", "wb") as sink:
        shard = archives._Shard(sink)
        for i in range(members):
            shard.add(f"é/{i}.txt", io.BytesIO(b"%d" % i))
            assert len(shard.part.filelist) <= held
        shard.finish()
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        want = [(i.filename, i.file_size, i.header_offset) for i in z.infolist()]
        assert len(want) == members and z.read(f"é/{members - 1}.txt") == b"%d" % (members - 1) and (members > 100 or z.testzip() is None)
    (tmp_path / "b.zip").write_bytes(b"put before" + (tmp_path / "a.zip").read_bytes())
    parts, whole = [], archives._infos
    monkeypatch.setattr(archives, "_infos", lambda entries: parts.append(len(entries)) or whole(entries))
    for name, before in (("a.zip", 0), ("b.zip", 10)):
        with open(tmp_path / name, "rb") as file:
            start, size, extra = archives._directory(file)
            assert extra == before and [(i.filename, i.file_size, i.header_offset) for i, _ in archives._entries(file, start, size)] == want
    assert max(parts) <= held


def test_an_archive_of_many_small_members_is_read_by_several_tasks(spark, tmp_path):
    with open(tmp_path / "a.zip", "wb") as sink:
        shard = archives._Shard(sink)
        for i in range(20_000):
            shard.add(f"{i % 3}/{i}.txt", io.BytesIO(b"%d" % i))
        shard.finish()
    found = zips(spark, tmp_path)
    assert archives._listed(found, "path").select("slice").distinct().count() > 1
    got = archives.extract_archive(found, str(tmp_path / "new")).agg(F.count("member"), F.count("error"), F.sum("length")).first()
    assert tuple(got) == (20_000, 0, sum(len(str(i)) for i in range(20_000)))
    assert all((tmp_path / "new" / str(i % 3) / f"{i}.txt").read_bytes() == b"%d" % i for i in range(0, 20_000, 7))


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_the_last_member_of_a_name_is_read_for_all(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, text in (("a", "old"), ("b", "other"), ("a", "newer")):
            z.writestr(name, text)
    (tmp_path / "a.zip").write_bytes(b"put before" + (tmp_path / "a.zip").read_bytes())
    rows = archives.import_archive(zips(spark, tmp_path)).collect()
    assert sorted((r["member"], r["length"], bytes(r["content"]), r["error"]) for r in rows) == [
        ("a", 3, b"newer", None), ("a", 5, b"newer", None), ("b", 5, b"other", None)]
