import pytest
from conftest import GRADIENT, png
from pyspark.sql import functions as F

from lumisift.functions import pixels
from lumisift.operators import fingerprints, quality
from lumisift.schemas import IMAGE
from lumisift.sources import files, image_info


def names(df, *columns):
    return {r["path"].rsplit("/", 1)[1]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_report_finds_cut_files(spark, image_tree):
    found = files.scan_files(spark, [str(image_tree)])
    report = names(quality.check_images(found, quality.REPORT), "problem")
    sound = {"a.png", "b.png", "c.png", "info.png", "wide.png", "_h.png", ".d.png", "a.txt", "orphan.txt"}
    assert report == dict.fromkeys(sound) | {"trunc.png": "truncated", "late.png": "truncated"}
    assert set(names(quality.check_images(found, quality.DELETE), "path")) == sound
    repaired = names(quality.check_images(found, quality.REPAIR), "quarantine")
    assert repaired["trunc.png"] and not repaired["a.png"] and len(repaired) == 11
    assert quality.check_images(found, quality.SKIP).columns == found.columns
    with pytest.raises(ValueError):
        quality.check_images(found, 3)


def test_decode_flag_counts_too(spark, image_tree):
    images = quality.read_images(spark, str(image_tree))
    flags = names(quality.decoded_flags(images), "ok")
    assert not flags["trunc.png"] and flags["late.png"] and flags["a.png"]
    found = files.scan_files(spark, [str(image_tree)]).filter(~F.col("path").contains("sub"))
    without = quality.decoded_flags(images).withColumn("ok", F.col("ok") & ~F.col("path").contains("c.png"))
    assert names(quality.check_images(found, 0, without), "problem")["c.png"] == "undecodable"


def test_formats(spark):
    rows = [("jpeg", b"\xff\xd8\xff\xe0" + b"0" * 50 + b"\xff\xd9\0\0"), ("cut jpeg", b"\xff\xd8\xff\xe0" + b"0" * 90),
            ("gif", b"GIF89a" + b"0" * 30 + b";"), ("other", b"hello"), ("empty", b""), ("null", None)]
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0x80, 0, 0]) + b"\0" * 6 + b"!\xf9\x04\0\0\0\0\0" + b",\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    bmp, webp = b"BM" + (60).to_bytes(4, "little") + b"0" * 54, b"RIFF" + (20).to_bytes(4, "little") + b"WEBP" + b"0" * 16
    rows += [("real gif", gif), ("cut real gif", gif[:-3]), ("gif, one mark", b"GIF89a" + b"\0" * 7 + b";" + b"\0" * 60), ("bmp", bmp), ("cut bmp", bmp[:-1]),
             ("webp", webp), ("cut webp", webp[:-2]), ("jpeg, trailer", b"\xff\xd8\xff\xe0" + b"0" * 50 + b"\xff\xd9" + b"t" * 500)]
    df = spark.createDataFrame(rows, "name string, content binary")
    got = {r["name"]: r["problem"] for r in quality.check_content(df, quality.REPORT).collect()}
    bad = {"cut jpeg", "gif", "cut real gif", "cut bmp", "cut webp"}
    assert got == {n: "unreadable" if n in ("empty", "null") else "truncated" if n in bad else None for n, _ in rows}


def test_files_that_cannot_be_read_are_not_deleted(spark, image_tree):
    found = files.scan_files(spark, [str(image_tree)], "a.png").select("path").unionByName(spark.createDataFrame([("file:/nowhere/x.png",)], "path string"))
    assert names(quality.check_images(found, quality.DELETE), "error")["x.png"] and len(quality.check_images(found, quality.DELETE).collect()) == 2
    assert names(quality.check_images(found, quality.REPORT), "problem") == {"a.png": None, "x.png": None}
    with pytest.raises(Exception, match="no file system"):
        quality.check_images(spark.createDataFrame([("odd://a/x.png",)], "path string")).collect()


def test_names_of_object_stores(monkeypatch):
    asked = []
    monkeypatch.setattr(files.pafs, "FileSystem", type("FileSystem", (), {"from_uri": staticmethod(asked.append)}))
    for uri in ("s3a://bucket/a b.png", "s3n://bucket/a b.png", "s3://bucket/a b.png"):
        files.open_fs(uri)
    assert asked == ["s3://bucket/a%20b.png"] * 3


def test_generation_info(spark, image_tree):
    found = files.scan_files(spark, [str(image_tree)])
    got = names(image_info.read_generation_info(found), "info", "error")
    assert got["info.png"] == ({"parameters": "steps: 20, a (b)"}, None) and got["a.png"] == ({}, None)
    assert got["a.txt"][0] is None and "not a PNG" in got["a.txt"][1]
    blank = spark.createDataFrame([("",), ("file:/nowhere/x.png",)], "path string")
    assert all(r["info"] is None and r["error"] for r in image_info.read_generation_info(blank).collect())


def test_content_is_read_on_demand(spark, image_tree):
    found = files.scan_files(spark, [str(image_tree)], "*.png").unionByName(
        spark.createDataFrame([("file:/nowhere.png", "r", 1, None)], files.FILES))
    got = names(files.read_content(found), "content", "error")
    assert bytes(got["b.png"][0]) == png(GRADIENT) and got["nowhere.png"][0] is None and got["nowhere.png"][1]


def test_thumbnails(spark, image_tree):
    images = quality.read_images(spark, str(image_tree))
    sizes = names(quality.thumbnail(images, 20).select("path", "image.height", "image.width", F.length("image.data").alias("n")),
                  "height", "width", "n")
    assert sizes["a.png"] == (12, 20, 240 * 1) and sizes["wide.png"] == (1, 20, 20) and sizes["trunc.png"] == (None, None, None)
    same = names(quality.thumbnail(images, 2000).select("path", F.col("image.data").alias("d")), "d")
    assert same["a.png"] == names(images.select("path", F.col("image.data").alias("d")), "d")["a.png"]


def test_area_mean_keeps_the_mean():
    import numpy as np

    x = np.random.default_rng(1).integers(0, 256, (17, 23, 3))
    small = pixels.area_mean(x, 5, 9)
    assert small.shape == (5, 9, 3) and np.allclose(small.mean((0, 1)), x.mean((0, 1)))
    assert np.allclose(pixels.area_mean(x, 17, 23), x)


@pytest.mark.parametrize("kind", ["average", "difference"])
def test_fingerprints(spark, image_tree, kind):
    images = quality.read_images(spark, str(image_tree))
    got = names(fingerprints.image_fingerprint(images, kind), "hash")
    assert got["a.png"] == got["b.png"] and got["trunc.png"] is None
    assert bin((got["a.png"] ^ got["c.png"]) & (1 << 64) - 1).count("1") <= 2


def test_grid_bits(spark):
    rows = [(1, [float(i) for i in range(64)]), (2, [5.0] * 64), (3, None), (4, [1.0] * 9)]
    df = spark.createDataFrame(rows, "id int, grid array<double>")
    got = {r["id"]: (r["hi"], r["lo"]) for r in fingerprints.grid_fingerprint(df).collect()}
    assert got == {1: (0, 2**32 - 1), 2: (0, 0), 3: (None, None), 4: (None, None)}
    rising = spark.createDataFrame([(1, [float(i) for i in range(72)])], "id int, grid array<double>")
    assert fingerprints.grid_fingerprint(rising, kind="difference").first()["hash"] == -1


def test_colour_order(spark):
    row = [("", 1, 1, 3, 16, bytes([255, 0, 0]))]  # blue, in BGR order
    df = spark.createDataFrame([(r,) for r in row], "image struct<origin string, height int, width int, nChannels int, mode int, data binary>")
    assert df.schema["image"].dataType == IMAGE
    assert abs(df.select(pixels.grey_grid(1, 1)("image").alias("g")).first()["g"][0] - 255 * 0.114) < 1e-6


def test_repeated_and_oversized_text_entries():
    import io
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    start = b"\x89PNG\r\n\x1a\n"
    twice = start + chunk(b"tEXt", b"k\0one") + chunk(b"zTXt", b"k\0\0" + zlib.compress(b"two")) + chunk(b"IEND", b"")
    assert image_info.png_text(io.BytesIO(twice)) == {"k": "one\ntwo"}
    bomb = start + chunk(b"zTXt", b"k\0\0" + zlib.compress(b"0" * (image_info.MAX_TEXT + 1)))
    with pytest.raises(ValueError, match="more than"):
        image_info.png_text(io.BytesIO(bomb))
