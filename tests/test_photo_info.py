import io
import struct

import pytest

from lumisift.sources import image_info as ii


def tiff(entries, order="<", following=0, pointers=()):
    """One directory of (tag, kind, bytes) entries and (tag, offset) pointers."""
    n = len(entries) + len(pointers)
    body, data = b"", b""
    at = 8 + 2 + 12 * n + 4
    for tag, kind, raw in entries:
        count = len(raw)
        place = raw.ljust(4, b"\0") if count <= 4 else struct.pack(order + "I", at + len(data))
        data += raw if count > 4 else b""
        body += struct.pack(order + "HHI", tag, kind, count) + place
    for tag, offset in pointers:
        body += struct.pack(order + "HHII", tag, 4, 1, offset)
    mark = b"II" if order == "<" else b"MM"
    return mark + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", n) + body + struct.pack(order + "I", following) + data


def jpeg(*segments, end=b"\xff\xda\x00\x02\x01\x02\xff\xd9"):
    return ii.JPEG_START + b"".join(b"\xff" + bytes([k]) + struct.pack(">H", len(b) + 2) + b for k, b in segments) + end


def webp(*chunks):
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for k, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read(data):
    return ii.image_text(io.BytesIO(data))


COMMENT = "steps: 20, é \U0001F600"


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif_text_of_jpeg_and_webp(order):
    wide = b"UNICODE\0" + COMMENT.encode("utf-16-le" if order == "<" else "utf-16-be")
    tags = tiff([(0x010E, 2, b"a long description\0"), (0x013B, 2, b"me\0"), (0x9286, 7, wide), (0x9C9C, 1, "hé\0".encode("utf-16-le")), (0x0112, 3, b"\1\0")], order)
    want = {"ImageDescription": "a long description", "Artist": "me", "UserComment": COMMENT, "XPComment": "hé"}
    assert read(jpeg((0xE0, b"JFIF\0"), (0xE1, ii.EXIF + tags))) == want
    assert read(webp((b"VP8X", b"\0" * 10), (b"VP8 ", b"\xff" * 9), (b"EXIF", tags))) == want
    assert read(webp((b"EXIF", ii.EXIF + tags))) == want


def test_comments_packets_and_charsets():
    packet = "<x:xmpmeta>é</x:xmpmeta>"
    got = read(jpeg((0xFE, b"one"), (0xFE, "zwei ü".encode("latin-1")), (0xE1, ii.XMP + packet.encode()), (0xE1, b"other")))
    assert got == {"comment": "one\nzwei ü", ii.XMP_NAME: packet}
    assert read(webp((b"XMP ", packet.encode()))) == {ii.XMP_NAME: packet}
    for raw in (b"ASCII\0\0\0plain\0\0", b"\0" * 8 + b"plain", b"JIS\0\0\0\0\0plain", b"UNICODE\0\xff\xfe" + "plain".encode("utf-16-le")):
        text = read(jpeg((0xE1, ii.EXIF + tiff([(0x9286, 7, raw)]))))["UserComment"]
        assert text == "plain"
    assert read(jpeg((0xE1, ii.EXIF + tiff([(0x9286, 7, b"no character set")]))))["UserComment"] == "no character set"
    # Metadata after the pixels, or between filling bytes.
    assert read(ii.JPEG_START + b"\xff\xff\xff\xfe\x00\x05abc\xff\xd9") == {"comment": "abc"}


def test_directories_are_bounded():
    head = tiff([(0x0131, 2, b"a tool\0")], pointers=[(0x8769, 45)])  # 8 + 2 + 2 * 12 + 4 + 7
    assert len(head) == 45
    deeper = struct.pack("<HHHII", 1, 0x9286, 7, 12, 45 + 18) + b"\0" * 4 + b"ASCII\0\0\0deep"
    assert ii.tiff_text(head + deeper) == [("Software", "a tool"), ("UserComment", "deep")]
    for bad, what in [
        (tiff([(0x013B, 2, b"me\0")], following=8), "cycle"),
        (tiff([], pointers=[(0x8769, 8)]), "cycle"),
        (tiff([(0x013B, 2, b"me\0")], following=5000), "beyond"),
        (b"II*\0\x08\0\0\0" + struct.pack("<H", 65535), "too many"),
        (tiff([])[:8] + struct.pack("<HHHII", 1, 0x010E, 2, 1 << 31, 8) + b"\0" * 4, "beyond"),
        (b"XX*\0\x08\0\0\0", "header"), (b"", "header"),
    ]:
        with pytest.raises(ValueError, match=what):
            ii.tiff_text(bad)
    chain = b"II*\0" + struct.pack("<I", 8) + b"".join(struct.pack("<HI", 0, 8 + 6 * (i + 1)) for i in range(100))
    with pytest.raises(ValueError, match="too many|beyond"):
        ii.tiff_text(chain)


def test_damaged_files_are_error_rows(spark, tmp_path):
    tags = ii.EXIF + tiff([(0x013B, 2, b"somebody\0")])
    good, photo = jpeg((0xE1, tags)), webp((b"EXIF", tags))
    cases = [("good", good, None), ("photo", photo, None), ("cut", good[:30], "cut off"), ("cut2", photo[:40], "cut off"), ("text", b"hello world!", "not a PNG"),
             ("empty", b"", "not a PNG"), ("none", None, "not a PNG"), ("nolength", ii.JPEG_START + b"\xff\xe1\0\1", "without a length"),
             ("nosegment", ii.JPEG_START + b"abc", "no segment"), ("open", ii.JPEG_START + b"\xff\xe0\0\2", "no segment"),
             ("cycle", jpeg((0xE1, ii.EXIF + tiff([], following=8))), "cycle"), ("badxmp", webp((b"XMP ", b"\xff\xff")), "UnicodeDecodeError")]
    df = spark.createDataFrame([(n, None if d is None else bytearray(d)) for n, d, _ in cases], "name string, content binary")
    got = {r["name"]: r for r in ii.read_generation_info(df, content="content").collect()}
    for name, _, error in cases:
        if error is None:
            assert got[name]["info"] == {"Artist": "somebody"} and got[name]["error"] is None
        else:
            assert got[name]["info"] is None and error in got[name]["error"]
    (tmp_path / "a.jpg").write_bytes(good)
    (tmp_path / "b.webp").write_bytes(photo)
    files = spark.createDataFrame([(f"file:{tmp_path}/a.jpg",), (f"file:{tmp_path}/b.webp",)], "path string")
    assert [r["info"] for r in ii.read_generation_info(files).collect()] == [{"Artist": "somebody"}] * 2


def test_png_files_may_hold_tags_too():
    import zlib
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = ii.PNG_SIGNATURE + chunk(b"tEXt", b"parameters\0p") + chunk(b"eXIf", tiff([(0x0131, 2, b"a tool\0")])) + chunk(b"IEND", b"")
    assert read(data) == {"parameters": "p", "Software": "a tool"}
