"""Listing files below folders, and reading only the bytes that are asked for."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from itertools import islice
from urllib.parse import quote, urlparse

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.functions.tags import last_segment
from lumisift.schemas import FILES, require  # noqa: F401
from lumisift.session import pin

# Extensions taken for images.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "bmp")


def to_uri(path: str, base: str | None = None) -> str:
    """Absolute URI without a closing slash; a plain path is a `file:` one below `base`.

    Paths that differ only in `..`, `.` or doubled slashes become equal. Names are
    written as they are, without percent escapes.
    """
    if "://" in path or path.startswith("file:"):
        scheme, rest = path.split(":", 1)
        if scheme == "file":
            return "file:" + posixpath.normpath("/" + rest.lstrip("/"))
        return path.rstrip("/")
    return "file:" + posixpath.normpath(posixpath.join(base or os.getcwd(), path))


def resolve_roots(roots: Sequence[str], base: str | None = None) -> list[str]:
    """Distinct root URIs; relative ones are taken from `base`, e.g. a config file's folder."""
    return list(dict.fromkeys(to_uri(r.strip(), base) for r in roots if r.strip()))


def outermost(roots: list[str]) -> list[str]:
    """Roots that lie below no other root: reading these meets every path exactly once."""
    return [r for r in roots if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in roots)]


def scan_files(spark: SparkSession, roots: Sequence[str], glob: str = "*", base: str | None = None) -> DataFrame:
    """files(path, root, length, mtime) below all `roots` whose names match `glob`, each path once.

    Every file is listed, names that begin with `_` or `.` included, and roots are names
    as they stand, whatever characters they hold. Folders are listed in tasks, level by
    level, so the driver holds only the roots. Overlapping roots are normal: only the
    outermost are listed, and `root` is the longest root that holds the path. No file is
    opened.
    """
    found = walk_files(spark, roots, base)
    return found if glob == "*" else found.filter(last_segment(F.col("path")).rlike(glob_pattern(glob)))


def glob_pattern(glob: str) -> str:
    """Regular expression of a name pattern with `*`, `?`, `[...]` and `{a,b}`."""
    out, depth, at = "", 0, 0
    while at < len(glob):
        c = glob[at]
        if c == "[" and (end := glob.find("]", at + 2)) > 0:
            out += "[" + glob[at + 1:end].replace("\\", "\\\\").replace("[", "\\[").replace("!", "^", 1) + "]"
            at = end
        elif c in "{}":
            depth += 1 if c == "{" else -1
            out += "(?:" if c == "{" else ")"
        else:
            out += {"*": ".*", "?": "."}.get(c) or ("|" if c == "," and depth else re.escape(c))
        at += 1
    return f"(?s)^{out}$"


def _root_of(path: Column, roots: list[str]) -> Column:
    column = F
    for root in sorted(roots, key=len, reverse=True):
        column = column.when(path.startswith(root.rstrip("/") + "/") | (path == root), F.lit(root))
    return column


def plain_path(uri: Column) -> Column:
    """Escaped URI, as in `_metadata.file_path`, -> the plain form of the binaryFile source."""
    one_slash = F.regexp_replace(uri, "^file:/+", "file:/")
    return F.url_decode(F.replace(one_slash, F.lit("+"), F.lit("%2B")))  # a plus sign is no blank here


def walk_files(spark: SparkSession, roots: Sequence[str], base: str | None = None, max_depth: int = 64) -> DataFrame:
    """The same rows for trees too large to list on the driver, hidden names included.

    Each round lists one level of folders in parallel tasks: the driver holds only
    the roots. Folders found become the next round's input.
    """
    roots = resolve_roots(roots, base)
    level = spark.createDataFrame([(r,) for r in outermost(roots)], "path string")
    files = None
    for _ in range(max_depth):
        listed = pin(level.repartition(spark.sparkContext.defaultParallelism, "path")
                     .mapInPandas(_list_folders, "path string, length bigint, mtime timestamp, is_folder boolean"))
        here = listed.filter(~F.col("is_folder")).select("path", "length", "mtime")
        files = here if files is None else files.unionByName(here)
        level = listed.filter("is_folder").select("path")
        if level.isEmpty():
            return files.select("path", _root_of(F.col("path"), roots).alias("root"), "length", "mtime")
    raise RuntimeError(f"folders nest deeper than {max_depth}")


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for uri in batch["path"]:
            entries = _entries(uri)
            while part := list(islice(entries, 10_000)):  # a folder of any size goes out in pieces
                names, sizes, times, folders = zip(*part)
                yield pd.DataFrame({
                    "path": [f"{uri.rstrip('/')}/{n}" for n in names],
                    "length": pd.array(sizes, "Int64"),
                    # The file source gives whole milliseconds.
                    "mtime": [datetime.fromtimestamp(t // 1_000_000 / 1000, timezone.utc).replace(tzinfo=None) for t in times],
                    "is_folder": folders,
                })


def _entries(uri: str) -> Iterator[tuple[str, int | None, int, bool]]:
    """(name, size, modification time in ns, is folder) of one folder's entries."""
    system, path = open_fs(uri)
    if isinstance(system, pafs.LocalFileSystem):
        with os.scandir(path) as found:  # streams; links to folders are not followed
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield e.name, None, 0, True
                elif e.is_file():
                    yield e.name, e.stat().st_size, e.stat().st_mtime_ns, False
        return
    for f in system.get_file_info(pafs.FileSelector(path, recursive=False)):
        folder = f.type == pafs.FileType.Directory
        yield f.base_name, None if folder else f.size, f.mtime_ns or 0, folder


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path inside it) of a URI; runs inside tasks."""
    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if scheme in ("s3a", "s3n"):  # Spark's names for the same store
        uri = "s3" + uri[len(scheme):]
    try:
        return pafs.FileSystem.from_uri(quote(uri, safe=":/@?&=,"))
    except pa.ArrowInvalid as e:
        # A path no reader here knows is a mistake of the caller, not a damaged file.
        raise RuntimeError(f"no file system for {uri}: {e}") from e


def is_image(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(last_segment(path), r"\.([^.]+)$", 1))
    return extension.isin(*IMAGE_EXTENSIONS)


def read_content(files: DataFrame, path: str = "path") -> DataFrame:
    """Add `content` and `error`: whole bytes, read in the task that owns the row."""
    require(files, path)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start, held, contents, errors = 0, 0, [], []
            for i, uri in enumerate(batch[path]):
                content, error = None, None
                try:
                    system, inner = open_fs(uri)
                    with system.open_input_stream(inner) as stream:
                        content = stream.read()
                except (OSError, pa.ArrowException) as e:
                    error = f"{type(e).__name__}: {e}"
                contents.append(content)
                errors.append(error)
                held += len(content or b"")
                if held >= 4 << 20 or i == len(batch) - 1:  # a task holds a few megabytes, or one file
                    yield batch.iloc[start:i + 1].assign(content=contents, error=errors)
                    start, held, contents, errors = i + 1, 0, [], []

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(load, f"{fields}, content binary, error string")
