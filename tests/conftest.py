import os
import struct
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lumisift.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", **{
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def png(rows, text=None, drop=0):
    """PNG bytes of a list of rows of grey levels, optionally with a text entry or a cut end."""
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width = len(rows), len(rows[0])
    pixels = b"".join(b"\0" + bytes(row) for row in rows)
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))]
    if text:
        parts.append(chunk(b"tEXt", b"parameters\0" + text.encode("latin-1")))
    parts += [chunk(b"IDAT", zlib.compress(pixels)), chunk(b"IEND", b"")]
    data = b"\x89PNG\r\n\x1a\n" + b"".join(parts)
    return data[:len(data) - drop]


GRADIENT = [[(8 * r + 3 * c) % 256 for c in range(40)] for r in range(24)]


@pytest.fixture(scope="session")
def image_tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    sub = root / "sub dir"
    sub.mkdir()
    (root / "empty").mkdir()
    good = png(GRADIENT)
    files = {
        "a.png": good, "sub dir/b.png": good,
        "c.png": png([[min(255, v + 1) for v in row] for row in GRADIENT]),
        "trunc.png": good[:len(good) // 2], "late.png": png(GRADIENT, drop=20),
        "_h.png": good, ".d.png": good, "info.png": png(GRADIENT, "steps: 20, a (b)"),
        "a.txt": "1girl, solo".encode(), "orphan.txt": b"x", "wide.png": png([[i % 256 for i in range(2000)]] * 10),
    }
    for name, data in files.items():
        (root / name).write_bytes(data)
    return root
