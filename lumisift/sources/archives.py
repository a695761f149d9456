"""Zip archives in and out, split over tasks by member."""

from __future__ import annotations

import io
import math
import re
import shutil
import struct
import tempfile
import uuid
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lumisift.schemas import MEMBERS, require
from lumisift.session import cut
from lumisift.sources.captions import _make_parent, safe_join, unsafe_member
from lumisift.sources.files import open_fs, to_uri

SHARD_BYTES = 1 << 30
SLICE_BYTES = 128 << 20  # packed bytes of one archive that one task reads
MEMBER_COST = 16 << 10  # packed bytes that take as long as opening a member
SHARD_NAME = re.compile(r"part-\d{5,}\.zip")
# What a binary cell holds. A larger member is an error row of `import_archive`;
# `extract_archive` streams members of any size.
MAX_MEMBER_BYTES = (1 << 31) - (1 << 20)
DIRECTORY_ROWS = 10_000  # entries of an archive's directory that a task holds
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1_000  # what a task holds before it hands rows on


def archive_manifest(files: DataFrame, base: str, out: str) -> DataFrame:
    """Add the archive `member` name of each file below `base`.

    Below a folder it is the path relative to that folder; when `base` is the file
    itself, its own name. The archive being written, if it lies inside `base`, is
    left out. Column work only.
    """
    require(files, "path")
    base, out = base.rstrip("/"), out.rstrip("/")
    if base == out:
        raise ValueError("the input and the output archive are the same path")
    path = F.col("path")
    member = (F.when(path == base, F.element_at(F.split(path, "/"), -1))
              .when(path.startswith(base + "/"), F.substring(path, len(base) + 2, 1 << 30)))
    return (files.filter((path != out) & ~path.startswith(out + "/")).withColumn("member", member)
            .filter(F.col("member").isNotNull()))


def plan_shards(manifest: DataFrame, shards: int | None = None) -> DataFrame:
    """Add the `shard` of each member: a hash of its name, one shard per GiB unless told."""
    require(manifest, "member", "length")
    if shards is None:
        total = manifest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        shards = max(1, math.ceil(total / SHARD_BYTES))
    if shards < 1:
        raise ValueError("shards must be at least 1")
    return manifest.withColumn("shard", F.pmod(F.xxhash64("member"), F.lit(shards)).cast("int"))


def export_archive(files: DataFrame, base: str, out: str, shards: int | None = None) -> int:
    """Pack files into `part-00000.zip`, ... below the folder `out`; returns the number of shards.

    Only names and paths are shuffled: the task that owns a shard opens its files
    and streams them into the deflated archive, so no content passes through Spark.
    Shards appear under their final names when the whole job has succeeded.
    """
    require(files, "path", "length")
    base, out = to_uri(base), to_uri(out)
    manifest = plan_shards(archive_manifest(files, base, out), shards)
    summary = manifest.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shard").alias("used"),
                           F.max("shard").alias("top")).first()
    if summary["n"] == 0:
        raise FileNotFoundError(f"nothing to archive below {base}")
    spark = files.sparkSession
    spark.dataSource.register(ZipShards)
    # One task per shard: a shard's rows must meet in one archive.
    placed = manifest.select("shard", "path", "member").repartitionById(summary["top"] + 1, F.col("shard"))
    placed.write.format("zip_shards").mode("append").option("folder", out).save()
    return summary["used"]


class ZipShards(DataSource):
    """Write-only source: (shard, path, member) rows become one zip per shard."""

    @classmethod
    def name(cls) -> str:
        return "zip_shards"

    def schema(self) -> str:
        return "shard int, path string, member string"

    def writer(self, schema, overwrite: bool) -> ZipShardWriter:
        return ZipShardWriter(self.options["folder"])


@dataclass
class Shards(WriterCommitMessage):
    partial: dict


class ZipShardWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, batches: Iterator[pa.RecordBatch]) -> Shards:
        system, root = open_fs(self.folder)
        system.create_dir(root, recursive=True)
        partial: dict[int, str] = {}
        open_zips: dict[int, _Shard] = {}
        try:
            for batch in batches:
                for shard, path, member in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if shard not in open_zips:
                        # One name per attempt: a retried or doubled task cannot clash.
                        partial[shard] = f"{root}/_{uuid.uuid4().hex}.part"
                        open_zips[shard] = _Shard(system.open_output_stream(partial[shard]))
                    source, inner = open_fs(path)
                    with source.open_input_stream(inner) as data:
                        open_zips[shard].add(member, data)
        except BaseException:
            # Nobody else knows the names of this attempt's files.
            for archive in open_zips.values():
                archive.close()
            for path in partial.values():
                if system.get_file_info(path).type == pafs.FileType.File:
                    system.delete_file(path)
            raise
        for archive in open_zips.values():
            archive.finish()
        return Shards(partial)

    def commit(self, messages: list[Shards | None]) -> None:
        system, root = open_fs(self.folder)
        written = set()
        for message in messages:
            for shard, path in (message.partial if message else {}).items():
                system.move(path, name := f"{root}/part-{shard:05d}.zip")
                written.add(name.rsplit("/", 1)[1])
        # An export replaces the one before: shards it did not write are older.
        for info in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if SHARD_NAME.fullmatch(info.base_name) and info.base_name not in written:
                system.delete_file(info.path)

    def abort(self, messages: list[Shards | None]) -> None:
        system, _ = open_fs(self.folder)
        for message in messages:
            for path in (message.partial if message else {}).values():
                if system.get_file_info(path).type == pafs.FileType.File:
                    system.delete_file(path)


class _Shard:
    """An archive being written to a stream. Its directory grows in a file of the executor, not in memory."""

    def __init__(self, sink):
        self.sink, self.at, self.count, self.aside = sink, 0, 0, None
        self.entries = tempfile.TemporaryFile()
        self.part = zipfile.ZipFile(self, "w", zipfile.ZIP_DEFLATED)

    # What an archive asks of a stream that only goes forward.
    def write(self, data) -> int:
        if self.aside is not None:
            self.aside += data
        else:
            self.sink.write(data)
            self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at + len(self.aside or b"")

    def flush(self) -> None:
        pass

    def add(self, member: str, data) -> None:
        with self.part.open(member, "w", force_zip64=True) as entry:
            while chunk := data.read(1 << 20):
                entry.write(chunk)
        self.count += 1
        if self.count % DIRECTORY_ROWS == 0:
            self._put_aside()
            self.part = zipfile.ZipFile(self, "w", zipfile.ZIP_DEFLATED)

    def _put_aside(self) -> None:
        """Take the entries of the members since the last time; they name places in the whole archive."""
        self.aside = bytearray()
        self.part.close()
        taken, self.aside = bytes(self.aside), None
        self.entries.write(taken[:struct.unpack("<L", taken[-10:-6])[0]])

    def finish(self) -> None:
        self._put_aside()
        start, size = self.at, self.entries.tell()
        self.entries.seek(0)
        shutil.copyfileobj(self.entries, self)
        self.write(_end_record(self.count, size, start))
        self.close()

    def close(self) -> None:
        self.part.fp = None  # nothing more is written when it is collected
        self.entries.close()
        self.sink.close()


def _end_record(count: int, size: int, start: int) -> bytes:
    """What follows a directory of `size` bytes at `start`."""
    wide = b""
    if count >= 0xFFFF or max(size, start) >= 0xFFFFFFFF:
        wide = struct.pack("<4sQ2H2L4Q4sLQL", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, start, b"PK\6\7", 0, start + size, 1)
    short = min(count, 0xFFFF)
    return wide + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, short, short, min(size, 0xFFFFFFFF), min(start, 0xFFFFFFFF), 0)


def _directory(file) -> tuple[int, int, int]:
    """(place of the directory, its size, bytes that were put before the archive)."""
    try:
        end = zipfile._EndRecData(file)
    except OSError:
        end = None
    if not end:
        raise zipfile.BadZipFile("File is not a zip file")
    start = end[zipfile._ECD_LOCATION] - end[zipfile._ECD_SIZE]
    if end[zipfile._ECD_SIGNATURE] == zipfile.stringEndArchive64:
        start -= zipfile.sizeEndCentDir64 + zipfile.sizeEndCentDir64Locator
    if start < 0:
        raise zipfile.BadZipFile("Bad offset for central directory")
    return start, end[zipfile._ECD_SIZE], start - end[zipfile._ECD_OFFSET]


def _infos(entries: list[bytes]) -> list[zipfile.ZipInfo]:
    directory = b"".join(entries)
    with zipfile.ZipFile(io.BytesIO(directory + _end_record(len(entries), len(directory), 0))) as part:
        return part.infolist()


def _entries(file, start: int, size: int) -> Iterator[tuple[zipfile.ZipInfo, bytes]]:
    """Members with the bytes of their directory entry; so many are held at a time, however many there are."""
    file.seek(start)
    held, at, entries = b"", 0, []
    while size or at < len(held):
        if len(held) - at < 1 << 18 and size:  # three names of the greatest length
            more = file.read(min(size, 1 << 20))
            size = size - len(more) if more else 0
            held, at = held[at:] + more, 0
        head = held[at:at + 46]
        if len(head) < 46:
            raise zipfile.BadZipFile("Truncated central directory")
        if head[:4] != b"PK\1\2":
            raise zipfile.BadZipFile("Bad magic number for central directory")
        length = 46 + sum(struct.unpack("<3H", head[28:34]))
        entries.append(held[at:at + length])
        at += length
        if len(entries) == DIRECTORY_ROWS:
            yield from zip(_infos(entries), entries, strict=True)
            entries = []
    yield from zip(_infos(entries), entries, strict=True)


def _whole(file, start: int, size: int, shift: int) -> tuple[np.ndarray, dict[str, tuple[bytes, int]]]:
    """Where the member or directory after each member begins; entry and that place of the last of each name used twice."""
    offsets, names = array("q"), array("q")
    for info, _ in _entries(file, start, size):
        offsets.append(info.header_offset + shift)
        names.append(hash(info.filename))
    begins = np.array(offsets, np.int64)
    order = np.argsort(begins, kind="stable")
    stops = np.empty_like(begins)
    stops[order] = np.append(begins[order], start)[1:]
    found, times = np.unique(np.array(names, np.int64), return_counts=True)
    twice = set(found[times > 1].tolist())
    if not twice:
        return stops, {}
    return stops, {info.filename: (entry, int(stops[k])) for k, (info, entry) in enumerate(_entries(file, start, size)) if hash(info.filename) in twice}


def _member(file, row) -> tuple[zipfile.ZipFile, zipfile.ZipInfo]:
    """An archive of one member, whose directory is the entry in the row, and that member."""
    archive = zipfile.ZipFile(io.BytesIO(row.entry + _end_record(1, len(row.entry), 0)))
    info = archive.infolist()[0]
    info.header_offset += int(row.shift)
    info._end_offset = int(row.stop)
    archive.fp = file
    return archive, info


def list_members(archives: DataFrame, path: str = "path") -> DataFrame:
    """members(archive, member, length, error) from the archives' directories; no member is read.

    Folder entries are left out. A broken archive gives one row with its error, and
    so does a member whose name would leave the target folder.
    """
    return _listed(archives, path).select("archive", "member", "length", "error")


def _listed(archives: DataFrame, path: str) -> DataFrame:
    """The members with their cost in packed bytes and `slice`, its place in the archive in steps of SLICE_BYTES.

    `entry`, `shift` and `stop` let a task read a member without the archive's directory: what
    it says of the member, what its places in the file are short of, and where the next begins.
    """
    require(archives, path)

    columns = ["archive", "member", "length", "error", "slice", "packed", "entry", "shift", "stop"]

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch[path]:
                try:
                    system, inner = open_fs(uri)
                    with system.open_input_file(inner) as file:
                        start, size, shift = _directory(file)
                        # Damage shows before any row goes out; 16 bytes a member are kept.
                        stops, last = _whole(file, start, size, shift)
                        rows, before = [], 0
                        for k, (info, entry) in enumerate(_entries(file, start, size)):
                            if not info.is_dir():
                                error = "unsafe name" if unsafe_member(info.filename) else None
                                entry, stop = last.get(info.filename) or (entry, int(stops[k]))
                                cost = info.compress_size + MEMBER_COST
                                rows.append((uri, info.filename, info.file_size, error, before // SLICE_BYTES, cost, entry, shift, stop))
                                before += cost
                            if len(rows) == DIRECTORY_ROWS:
                                yield _frame(rows, columns)
                                rows = []
                except (OSError, zipfile.BadZipFile, pa.ArrowException) as e:
                    rows = [(uri, None, None, f"{type(e).__name__}: {e}", 0, 0, None, 0, 0)]
                if rows:
                    yield _frame(rows, columns)

    return archives.select(path).mapInPandas(entries, "archive string, member string, length bigint, error string, slice bigint, packed bigint, entry binary, shift bigint, stop bigint")


def _placed(archives: DataFrame, path: str) -> DataFrame:
    """Members dealt out by archive and slice: an archive below a slice is opened by one task.

    The number of tasks follows the bytes and the members. The listing is written once, so that counting
    and reading do not list twice.
    """
    listed = cut(_listed(archives, path), "members")
    total = listed.agg(F.coalesce(F.sum("packed"), F.lit(0))).first()[0]
    tasks = max(archives.sparkSession.sparkContext.defaultParallelism, math.ceil(total / SLICE_BYTES))
    return listed.repartition(tasks, "archive", "slice").sortWithinPartitions("archive", "slice").drop("slice", "packed")


def import_archive(archives: DataFrame, path: str = "path", max_bytes: int = MAX_MEMBER_BYTES) -> DataFrame:
    """members(archive, member, length, content, error): one row per file in the archives.

    The directories are listed first and the members then dealt out in slices of so many
    bytes, so one huge archive is read by many tasks and a small one by a single task. A
    member above `max_bytes`, or damaged, gives a row with its error and no content.
    """
    return _placed(archives, path).mapInPandas(lambda batches: _read_members(batches, max_bytes), MEMBERS)


# What a damaged archive or member raises.
DAMAGE = (OSError, zipfile.BadZipFile, RuntimeError, NotImplementedError, KeyError, zlib.error, pa.ArrowException)


def _read_members(batches: Iterator[pd.DataFrame], max_bytes: int) -> Iterator[pd.DataFrame]:
    def content(file, row) -> bytes:
        if row.length > max_bytes:
            raise ValueError(f"member of {row.length} bytes is above the limit of {max_bytes}")
        archive, info = _member(file, row)
        return archive.read(info)

    rows, held = [], 0
    for row, value, error in _each_member(batches, content):
        rows.append((row.archive, row.member, row.length, value, error))
        held += len(value or b"")
        if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
            yield _frame(rows, ["archive", "member", "length", "content", "error"])
            rows, held = [], 0
    if rows:
        yield _frame(rows, ["archive", "member", "length", "content", "error"])


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"length": "Int64"})


def _each_member(batches: Iterator[pd.DataFrame], use):
    """(row, use(open file, row), error) per member; an archive's file stays open while its rows last."""
    current, file = None, None
    try:
        for batch in batches:
            for row in batch.itertuples(index=False):
                value, error = None, row.error
                if error is None:
                    try:
                        if row.archive != current:
                            if file is not None:
                                file.close()
                            current, file = None, None
                            system, inner = open_fs(row.archive)
                            file = system.open_input_file(inner)
                            current = row.archive
                        value = use(file, row)
                    except (ValueError, *DAMAGE) as e:
                        error = f"{type(e).__name__}: {e}"
                yield row, value, error
    finally:
        if file is not None:
            file.close()


def extract_archive(archives: DataFrame, out: str, path: str = "path") -> DataFrame:
    """Write every member below the folder `out`, in tasks; returns members(archive, member, length, error).

    A file appears under its name when complete. Nothing runs until the result is used.
    """
    require(archives, path)
    target = to_uri(out)
    for uri in (r[0] for r in archives.filter(F.col(path) == target).limit(1).collect()):
        raise ValueError(f"archive and output are the same path {uri}")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = open_fs(target)
        system.create_dir(root, recursive=True)
        made: set[str] = set()

        def copy(file, row) -> None:
            name = safe_join(root, row.member)
            _make_parent(system, name, made)
            partial = f"{name.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}.part"
            archive, info = _member(file, row)
            with archive.open(info) as data, system.open_output_stream(partial) as sink:
                while chunk := data.read(1 << 20):
                    sink.write(chunk)
            system.move(partial, name)

        rows = []
        for row, _, error in _each_member(batches, copy):
            rows.append((row.archive, row.member, row.length, error))
            if len(rows) >= BATCH_ROWS:
                yield _frame(rows, ["archive", "member", "length", "error"])
                rows = []
        if rows:
            yield _frame(rows, ["archive", "member", "length", "error"])

    return _placed(archives, path).mapInPandas(write, "archive string, member string, length bigint, error string")
