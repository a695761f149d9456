"""Text metadata kept inside PNG, JPEG and WebP files."""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.schemas import require
from lumisift.sources.files import open_fs

# Fixed values of the PNG format.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
TEXT_CHUNKS = (b"tEXt", b"zTXt", b"iTXt")


# Fixed values of JPEG, WebP and of the directories of tags that they may hold.
JPEG_START, EXIF, XMP = b"\xff\xd8", b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0"
XMP_NAME = "XML:com.adobe.xmp"
TAG_NAMES = {0x010D: "DocumentName", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "DateTime",
             0x013B: "Artist", 0x8298: "Copyright", 0x9003: "DateTimeOriginal", 0x9286: "UserComment",
             0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor", 0x9C9E: "XPKeywords", 0x9C9F: "XPSubject"}
DIRECTORY_TAGS = (0x8769, 0x8825, 0xA005)
UNIT_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}

MAX_TEXT = 64 << 20
# Bounds of one file's directories; real files have a handful, with some dozens of tags.
MAX_DIRECTORIES, MAX_TAGS = 64, 4096


def read_generation_info(images: DataFrame, path: str = "path", content: str | None = None) -> DataFrame:
    """Add `info map<string,string>` and `error`: every text entry of each PNG, JPEG or WebP image, unparsed.

    Of JPEG and WebP these are comments, XMP packets and the text tags of Exif
    directories, under their standard names; `parameters` picks the one that generators use.

    With `content`, bytes come from that column; otherwise the task opens the file at
    `path` and skips over pixel data. A file that cannot be read keeps its row, with
    a null `info`.
    """
    require(images, content or path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            infos, errors = [], []
            for source in batch[content or path]:
                info, error = None, None
                try:
                    info = _entries_at(source) if content is None else image_text(io.BytesIO(source or b""))
                except (OSError, ValueError, zlib.error, pa.ArrowException) as e:
                    error = f"{type(e).__name__}: {e}"
                infos.append(info)
                errors.append(error)
            kept = batch.drop(columns=[content]) if content else batch
            yield kept.assign(info=infos, error=errors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema if f.name != content)
    return images.mapInPandas(read, f"{fields}, info map<string,string>, error string")


def _entries_at(uri: str) -> dict[str, str]:
    if not uri:
        raise ValueError("empty path")
    system, inner = open_fs(uri)
    with system.open_input_file(inner) as f:
        return image_text(f)


def parameters(info: Column) -> Column:
    """The text that image generators write: the PNG entry `parameters`, else the comment of other formats."""
    return F.coalesce(*[info[name] for name in ("parameters", "UserComment", "comment", "ImageDescription")])


def image_text(f) -> dict[str, str]:
    """Text entries of a seekable image stream, whatever its name says it is."""
    start = f.read(12)
    f.seek(0)
    if start[:8] == PNG_SIGNATURE:
        return png_text(f)
    if start[:2] == JPEG_START:
        return jpeg_text(f)
    if start[:4] == b"RIFF" and start[8:] == b"WEBP":
        return webp_text(f)
    raise ValueError("not a PNG, JPEG or WebP file")


def jpeg_text(f) -> dict[str, str]:
    """Text entries of a JPEG stream: the segments before its first scan, others skipped without reading."""
    if f.read(2) != JPEG_START:
        raise ValueError("not a JPEG file")
    out: dict[str, str] = {}
    while True:
        if f.read(1) != b"\xff":
            raise ValueError("no segment where one should begin")
        while (mark := f.read(1)) == b"\xff":  # filling
            pass
        if not mark:
            raise ValueError("cut off before the image")
        kind = mark[0]
        if kind in (0xD9, 0xDA):  # end, or the pixels of a scan
            return out
        if kind == 0x01 or 0xD0 <= kind <= 0xD7:
            continue
        length = int.from_bytes(head, "big") if len(head := f.read(2)) == 2 else 0
        if length < 2:
            raise ValueError("segment without a length")
        if kind not in (0xE1, 0xFE):
            f.seek(f.tell() + length - 2)
            continue
        body = f.read(length - 2)
        if len(body) < length - 2:
            raise ValueError("cut off inside a segment")
        if kind == 0xFE:
            _add(out, "comment", _text(body))
        elif body.startswith(EXIF):
            for name, value in tiff_text(body[len(EXIF):]):
                _add(out, name, value)
        elif body.startswith(XMP):
            _add(out, XMP_NAME, body[len(XMP):].decode("utf-8"))


def webp_text(f) -> dict[str, str]:
    """Text entries of a WebP stream; chunks of pixels are skipped without reading."""
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:] != b"WEBP":
        raise ValueError("not a WebP file")
    end = 8 + int.from_bytes(head[4:8], "little")
    out: dict[str, str] = {}
    while f.tell() + 8 <= end and len(header := f.read(8)) == 8:
        kind, length = header[:4], int.from_bytes(header[4:], "little")
        if kind in (b"EXIF", b"XMP "):
            if length > MAX_TEXT:
                raise ValueError(f"chunk of more than {MAX_TEXT} bytes")
            body = f.read(length)
            if len(body) < length:
                raise ValueError("cut off inside a chunk")
            found = [(XMP_NAME, body.decode("utf-8"))] if kind == b"XMP " else tiff_text(body.removeprefix(EXIF))
            for name, value in found:
                _add(out, name, value)
            f.seek(f.tell() + length % 2)
        else:
            f.seek(f.tell() + length + length % 2)
    return out


def tiff_text(data: bytes) -> list[tuple[str, str]]:
    """(name, text) of the text tags of all directories that can be reached from the first.

    A directory is read once; one that is met again, or reaches beyond the data, and more
    than MAX_DIRECTORIES, MAX_TAGS or MAX_TEXT bytes are errors.
    """
    order = {b"II": "little", b"MM": "big"}.get(data[:2])
    if order is None or len(data) < 8 or int.from_bytes(data[2:4], order) != 42:
        raise ValueError("Exif data without a header")

    def number(at: int, size: int) -> int:
        if at + size > len(data):
            raise ValueError("Exif directory beyond its data")
        return int.from_bytes(data[at:at + size], order)

    out, tags, total = [], 0, 0
    left, seen = [number(4, 4)], set()
    while left:
        at = left.pop()
        if not at:
            continue
        if at in seen:
            raise ValueError("Exif directories in a cycle")
        seen.add(at)
        entries = number(at, 2)
        tags += entries
        if len(seen) > MAX_DIRECTORIES or tags > MAX_TAGS:
            raise ValueError("too many Exif directories or tags")
        for entry in range(at + 2, at + 2 + 12 * entries, 12):
            tag, kind, count = number(entry, 2), number(entry + 2, 2), number(entry + 4, 4)
            if tag in DIRECTORY_TAGS:
                left.append(number(entry + 8, 4))
            elif tag in TAG_NAMES and kind in (1, 2, 7):
                size = count * UNIT_BYTES[kind]
                begin = entry + 8 if size <= 4 else number(entry + 8, 4)
                total += size
                if begin + size > len(data) or total > MAX_TEXT:
                    raise ValueError("Exif text beyond its data")
                text = _tag_text(tag, data[begin:begin + size], order)
                if text:
                    out.append((TAG_NAMES[tag], text))
        left.append(number(at + 2 + 12 * entries, 4))
    return out


def _tag_text(tag: int, raw: bytes, order: str) -> str:
    if 0x9C9B <= tag <= 0x9C9F:
        return raw.decode("utf-16-le", "replace").rstrip("\0")
    if tag == 0x9286:
        kind, whole, raw = raw[:8], raw, raw[8:]
        if kind not in (b"UNICODE\0", b"JIS\0\0\0\0\0", b"ASCII\0\0\0", bytes(8)):
            return _text(whole)  # a writer that leaves the character set out
        if kind == b"UNICODE\0":
            marked = raw[:2] in (b"\xff\xfe", b"\xfe\xff")
            return raw.decode("utf-16" if marked else "utf-16-le" if order == "little" else "utf-16-be", "replace").rstrip("\0")
        if kind == b"JIS\0\0\0\0\0":
            return raw.decode("iso2022_jp", "replace").rstrip("\0")
    return _text(raw)


def _text(raw: bytes) -> str:
    """UTF-8 if it is valid, else Latin-1; without the zeros at its end."""
    raw = raw.rstrip(b"\0")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _add(out: dict[str, str], name: str, value: str) -> None:
    """A repeated name adds to the first."""
    out[name] = f"{out[name]}\n{value}" if name in out else value


def png_text(f) -> dict[str, str]:
    """Text entries of a seekable PNG stream; other chunks are skipped without reading."""
    if f.read(8) != PNG_SIGNATURE:
        raise ValueError("not a PNG file")
    out: dict[str, str] = {}
    while len(header := f.read(8)) == 8:
        length, kind = int.from_bytes(header[:4], "big"), header[4:]
        if kind in TEXT_CHUNKS:
            body = f.read(length)
            if len(body) < length:
                raise ValueError("cut off inside a text entry")
            key, value = _decode(kind, body)
            _add(out, key, value)
            f.seek(f.tell() + 4)
        elif kind == b"eXIf":
            if length > MAX_TEXT or len(body := f.read(length)) < length:
                raise ValueError("cut off inside a chunk of tags, or too long a one")
            for key, value in tiff_text(body):
                _add(out, key, value)
            f.seek(f.tell() + 4)
        else:
            f.seek(f.tell() + length + 4)
        if kind == b"IEND":
            break
    return out


def _decode(kind: bytes, body: bytes) -> tuple[str, str]:
    key, _, rest = body.partition(b"\0")
    name = key.decode("latin-1")
    if kind == b"tEXt":
        return name, rest.decode("latin-1")
    if kind == b"zTXt":
        return name, _inflate(rest[1:]).decode("latin-1")
    packed, rest = rest[:1] == b"\1", rest[2:]
    _, _, rest = rest.partition(b"\0")  # language
    _, _, text = rest.partition(b"\0")  # translated keyword
    return name, (_inflate(text) if packed else text).decode("utf-8")


def _inflate(data: bytes) -> bytes:
    """Unpacked text of at most MAX_TEXT bytes; more is an error of the file's row, not of the task."""
    unpack = zlib.decompressobj()
    out = unpack.decompress(data, MAX_TEXT)
    if unpack.unconsumed_tail:
        raise ValueError(f"text entry of more than {MAX_TEXT} bytes")
    return out
