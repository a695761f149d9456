"""Finding damaged images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.functions.pixels import resize
from lumisift.schemas import require
from lumisift.sources.files import is_image, open_fs, plain_path

# What to do with the outcome of a check.
SKIP, REPORT, REPAIR, DELETE = -1, 0, 1, 2

# First bytes of formats whose files end with a marker, and the marker.
ENDED = ((b"\x89PNG\r\n\x1a\n", b"IEND\xaeB`\x82"), (b"\xff\xd8\xff", b"\xff\xd9"))
TAIL = 64 * 1024  # the marker may be followed by so many bytes of padding or trailer


def file_problem(size: int, read: Callable[[int, int], bytes]) -> str | None:
    """What is wrong with an image file, or None; `read(n, offset)` gives bytes of it.

    PNG and JPEG must hold their end marker near the end, BMP and WebP be as long as
    their header says, and GIF be made of whole blocks up to its trailer. A format that
    is not known is not taken for damage.
    """
    if size == 0:
        return "unreadable"
    head = read(min(32, size), 0)
    for magic, marker in ENDED:
        if head.startswith(magic):
            return None if marker in read(min(TAIL, size), max(0, size - TAIL)) else "truncated"
    if head.startswith(b"BM") and size > 6:
        return "truncated" if size < int.from_bytes(head[2:6], "little") else None
    if head.startswith(b"RIFF") and head[8:12] == b"WEBP":
        return "truncated" if size < int.from_bytes(head[4:8], "little") + 8 else None
    if head.startswith((b"GIF87a", b"GIF89a")):
        return None if _gif_is_whole(size, read) else "truncated"
    return None


def _gif_is_whole(size: int, read: Callable[[int, int], bytes]) -> bool:
    """Follow the lengths of a GIF's blocks to its trailer."""
    held, base = b"", 0

    def byte(at: int) -> int:
        nonlocal held, base
        if at >= size:
            raise EOFError
        if not base <= at < base + len(held):
            held, base = read(min(1 << 16, size - at), at), at
        return held[at - base]

    def after_parts(at: int) -> int:
        while length := byte(at):
            at += length + 1
        return at + 1

    def table(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    try:
        at = 13 + table(byte(10))
        while True:
            kind = byte(at)
            if kind == 0x3B:
                return True
            if kind == 0x21:
                at = after_parts(at + 2)
            elif kind == 0x2C:
                at = after_parts(at + 11 + table(byte(at + 9)))
            else:
                return False
    except EOFError:
        return False


def check_content(df: DataFrame, mode: int, content: str = "content") -> DataFrame:
    """Check images whose bytes are a column; a null has the problem "unreadable"."""
    require(df, content)
    if mode == SKIP:
        return apply_mode(df, mode)

    @F.pandas_udf("string")
    def problem(values: pd.Series) -> pd.Series:
        return pd.Series([file_problem(len(v), lambda n, at, v=v: bytes(v[at:at + n])) if v is not None else "unreadable" for v in values],
                         dtype=object)

    return apply_mode(df.withColumn("problem", problem(F.col(content))), mode)


def check_images(files: DataFrame, mode: int = REPORT, decoded: DataFrame | None = None) -> DataFrame:
    """Check image files for damage: -1 skip, 0 report, 1 repair, 2 delete.

    Report adds `problem` (null when sound) and `error` to every file; repair keeps all
    rows and marks the damaged by `quarantine`; delete keeps all rows that are not known
    to be damaged. A file that could not be opened or read has an `error` and no
    problem: nothing is known of it, so it is never deleted. Files that are no images
    have neither. No file is ever changed. Only the ends of a file are read, but for GIF.
    Given `decoded` (path, ok), files listed there that do not decode count as damaged.
    """
    require(files, "path")
    if mode == SKIP:
        return apply_mode(files, mode)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            problems, errors = [], []
            for uri in batch["path"]:
                problem = error = None
                system, inner = open_fs(uri)
                try:
                    with system.open_input_file(inner) as f:
                        problem = file_problem(f.size(), f.read_at)
                except (OSError, pa.ArrowException) as e:
                    error = f"{type(e).__name__}: {e}"
                problems.append(problem)
                errors.append(error)
            yield batch.assign(problem=pd.Series(problems, index=batch.index, dtype=object),
                               error=pd.Series(errors, index=batch.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    checked = files.mapInPandas(check, f"{fields}, problem string, error string")
    if decoded is not None:
        require(decoded, "path", "ok")
        checked = (checked.join(decoded.select("path", F.col("ok").alias("_ok")), "path", "left")
                   .withColumn("problem", F.coalesce(F.col("problem"), F.when(~F.col("_ok"), F.lit("undecodable")))).drop("_ok"))
    return apply_mode(checked, mode)


def apply_mode(checked: DataFrame, mode: int) -> DataFrame:
    if mode == SKIP:
        return checked
    if mode == REPORT:
        return checked
    if mode == REPAIR:
        return checked.withColumn("quarantine", F.col("problem").isNotNull())
    if mode == DELETE:
        return checked.filter(F.col("problem").isNull()).drop("problem")
    raise ValueError("mode must be -1, 0, 1 or 2")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, image): every image of a folder tree, decoded by Spark's image source.

    An image that cannot be decoded has a null `image`.
    """
    loaded = spark.read.format("image").option("recursiveFileLookup", True).load(folder)
    return (loaded.select(plain_path(F.col("image.origin")).alias("path"), "image").filter(is_image(F.col("path")))
            .withColumn("image", F.when(F.col("image.height") > 0, F.col("image"))))


def decoded_flags(images: DataFrame) -> DataFrame:
    require(images, "path", "image")
    return images.select("path", F.col("image").isNotNull().alias("ok"))


def thumbnail(images: DataFrame, max_resolution: int = 512, image: str = "image") -> DataFrame:
    """Shrink images to at most `max_resolution` on the longer side; never enlarge.

    Area means in Arrow batches, channel order kept. An undecoded image stays null.
    """
    require(images, image)
    if max_resolution < 1:
        raise ValueError("max_resolution must be at least 1")
    return images.withColumn(image, F.when(F.col(image).isNotNull(), resize(max_resolution)(F.col(image))))
