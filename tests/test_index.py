import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumisift.operators import index
from lumisift.sources import captions, files, tables
from lumisift.streaming.arrivals import index_arrivals

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "path string, root string, length long, mtime timestamp"


def frame(spark, rows):
    return spark.createDataFrame([(p, "r", n, T0 + dt.timedelta(seconds=s)) for p, n, s in rows], SCHEMA)


def test_changes_and_snapshots(spark, tmp_path):
    folder = str(tmp_path / "index")
    first = frame(spark, [("a", 1, 0), ("b", 2, 0), ("c", 3, 0)])
    assert {r["change"] for r in tables.refresh_index(first, folder).collect()} == {"new"}
    second = frame(spark, [("a", 1, 0), ("b", 5, 0), ("d", 4, 0)])
    changes = {r["path"]: (r["change"], r["length"]) for r in tables.refresh_index(second, folder).collect()}
    assert changes == {"a": ("same", 1), "b": ("changed", 5), "c": ("deleted", 3), "d": ("new", 4)}
    assert tables.current_version(spark, folder) == 2
    assert {tuple(r) for r in tables.read_index(spark, folder).collect()} == {tuple(r) for r in second.collect()}


def test_pages_cover_everything_once(spark):
    rows = [(f"p{i:02d}", None if i % 5 == 0 else i % 3, 0) for i in range(23)]
    df = frame(spark, rows)
    seen, after = [], None
    while True:
        page = index.browse(df, order_by=["-length"], after=after, limit=4).collect()
        if not page:
            break
        seen += [r["path"] for r in page]
        after = (page[-1]["length"], page[-1]["path"])
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert seen == [r[0] for r in want]


def test_scan_lists_each_path_once(spark, image_tree):
    roots = [str(image_tree), str(image_tree / "sub dir"), f" {image_tree}/../{image_tree.name} "]
    found = {r["path"].rsplit("/", 1)[1]: r["root"] for r in files.scan_files(spark, roots, "*.png").collect()}
    assert set(found) == {"a.png", "b.png", "c.png", "trunc.png", "late.png", "info.png", "wide.png", "_h.png", ".d.png"}
    assert found["a.png"] == f"file:{image_tree}" and found["b.png"] == f"file:{image_tree}/sub dir"


def test_walk_adds_hidden_files(spark, image_tree):
    walked = files.walk_files(spark, [str(image_tree), str(image_tree / "sub dir")])
    names = [r["path"].rsplit("/", 1)[1] for r in walked.collect()]
    assert len(names) == len(set(names)) == 11 and {"_h.png", ".d.png"} <= set(names)
    common = ["path", "root", "length", "mtime"]
    scanned = files.scan_files(spark, [str(image_tree), str(image_tree / "sub dir")])
    assert {tuple(r) for r in walked.select(common).collect()} == {tuple(r) for r in scanned.select(common).collect()}


def test_roots_are_names_not_patterns(spark, tmp_path):
    for name in ("set [1]", "set 1", "a{b}*"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.TXT").write_text(name)
    for name in ("set [1]", "set 1", "a{b}*"):
        assert [r["path"] for r in files.scan_files(spark, [str(tmp_path / name)]).collect()] == [f"file:{tmp_path}/{name}/{name}.TXT"]
        assert [r["caption"] for r in captions.read_captions(spark, [str(tmp_path / name)]).collect()] == [name]


@pytest.mark.parametrize("glob, name, want", [
    ("*.{png,jpg}", "a.jpg", True), ("*.{png,jpg}", "a.gif", False), ("a?.txt", "ab.txt", True), ("a?.txt", "a.txt", False),
    ("[!a]*", "b", True), ("[!a]*", "a", False), ("a+(b)", "a+(b)", True), ("*", "", True)])
def test_name_patterns(spark, glob, name, want):
    assert spark.range(1).select(F.lit(name).rlike(files.glob_pattern(glob))).first()[0] is want


def test_relative_roots(tmp_path):
    assert files.resolve_roots(["images", "./images", "", " x/../images"], str(tmp_path)) == [f"file:{tmp_path}/images"]


def test_captions_and_orphans(spark, image_tree):
    images = files.scan_files(spark, [str(image_tree)], "*.png")
    texts = captions.read_captions(spark, [str(image_tree)])
    paired = {r["path"].rsplit("/", 1)[1]: r["caption"] for r in index.attach_captions(images, texts).collect()}
    assert paired["a.png"] == "1girl, solo" and paired["b.png"] is None and len(paired) == 9
    assert [r["path"].rsplit("/", 1)[1] for r in index.orphan_captions(images, texts).collect()] == ["orphan.txt"]


def test_written_captions_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", "x, y"), ("deep/er/b c", "né\nz"), ("none", None)], "name string, caption string")
    captions.write_captions(df, str(tmp_path))
    captions.write_captions(df, str(tmp_path))  # again: same files
    got = {r["path"].split(f"{tmp_path.name}/")[1]: r["caption"] for r in captions.read_captions(spark, [str(tmp_path)]).collect()}
    assert got == {"a.txt": "x, y", "deep/er/b c.txt": "né\nz"}
    assert not [p for p in tmp_path.rglob("*") if p.name.endswith(".part")]
    with pytest.raises(ValueError, match="2 captions have the name 'a'"):
        captions.write_captions(spark.createDataFrame([("a", "1"), ("a", "2")], "name string, caption string"), str(tmp_path))
    captions.write_caption_table(df, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3
    with pytest.raises(Exception, match="unsafe"):
        captions.write_captions(spark.createDataFrame([("../up", "x")], "name string, caption string"), str(tmp_path))
    assert not [p for p in tmp_path.rglob("*") if p.name.endswith(".part")]


def test_captions_that_stopped_half_way(spark, tmp_path, monkeypatch):
    """A write that fails leaves the old files; one that stops while files are moved can be gone on with."""
    first = spark.createDataFrame([("a", "old a"), ("b/c", "old c")], "name string, caption string")
    captions.write_captions(first, str(tmp_path))
    with pytest.raises(Exception, match="unsafe"):
        captions.write_captions(spark.createDataFrame([("a", "new"), ("../x", "new")], "name string, caption string").coalesce(1), str(tmp_path))
    read = lambda: {p.relative_to(tmp_path).as_posix(): p.read_text() for p in tmp_path.rglob("*.txt") if ".part" not in str(p)}
    assert read() == {"a.txt": "old a", "b/c.txt": "old c"} and not list(tmp_path.glob("_*"))
    publish = captions.publish_captions
    monkeypatch.setattr(captions, "publish_captions", lambda spark, staging: None)
    captions.write_captions(first.selectExpr("name", "replace(caption, 'old', 'new') AS caption"), str(tmp_path))
    assert read() == {"a.txt": "old a", "b/c.txt": "old c"}
    staging, = tmp_path.glob("_*.part")
    next(p for p in staging.rglob("a.txt")).rename(tmp_path / "a.txt")  # moved before the job was lost
    publish(spark, f"file:{staging}")
    assert read() == {"a.txt": "new a", "b/c.txt": "new c"} and not staging.exists()


def test_arrivals_are_taken_once(spark, tmp_path):
    source, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    source.mkdir()

    def run():
        index_arrivals(spark, str(source), table, state).awaitTermination()
        return sorted(r["path"].rsplit("/", 1)[1] for r in spark.read.parquet(table).collect())

    (source / "a.png").write_bytes(b"1")
    assert run() == ["a.png"]
    (source / "b.png").write_bytes(b"22")
    assert run() == ["a.png", "b.png"]


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="mtime"):
        index.diff_index(spark.range(1).withColumnRenamed("id", "path"), spark.range(1).withColumnRenamed("id", "path"))
