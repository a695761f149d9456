"""Caption text files in and out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.schemas import require
from lumisift.sources.files import open_fs, read_content, scan_files, to_uri


def read_captions(spark: SparkSession, roots: Sequence[str], base: str | None = None) -> DataFrame:
    """texts(path, caption): every `.txt` below the roots, in either case, one row per file.

    Hidden names are read too. Bytes that are no UTF-8 become replacement characters. A
    file that cannot be read fails the job: a caption that is silently missing would be
    taken for none.
    """
    rows = read_content(scan_files(spark, roots, "*.[tT][xX][tT]", base).select("path"))
    failed = F.raise_error(F.concat(F.lit("cannot read "), F.col("path"), F.lit(": "), F.col("error")))
    text = F.when(F.col("error").isNotNull(), failed.cast("string")).otherwise(F.make_valid_utf8(F.col("content").cast("string")))
    return rows.select("path", text.alias("caption"))


def write_captions(df: DataFrame, folder: str, name: str = "name", caption: str = "caption") -> None:
    """Write one `<name>.txt` per row below `folder`, folders in the name included.

    A null caption writes nothing; two rows of one name raise an error before anything is
    written. Tasks write the files below a hidden folder and list them in a manifest, a
    written table; when all are there, tasks move them to their names. The driver sees
    neither names nor files. A job that fails before the manifest is whole leaves the
    old files as they were; one that fails while files are moved leaves each file either
    old or new, and the hidden folder, with its manifest, from which
    `publish_captions` goes on.
    """
    require(df, name, caption)
    spark = df.sparkSession
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(caption).cast("string").alias("caption"))
    rows = rows.filter(F.col("caption").isNotNull())
    twice = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
    if twice is not None:
        raise ValueError(f"{twice['n']} captions have the name {twice['name']!r}")
    staging = f"{to_uri(folder)}/_{uuid.uuid4().hex}.part"
    try:
        rows.mapInArrow(_staged(staging), "name string, staged string").write.parquet(f"{staging}/manifest")
    except BaseException:
        _remove(*open_fs(staging))
        raise
    publish_captions(spark, staging)


def publish_captions(spark: SparkSession, staging: str) -> None:
    """Move the files that a manifest lists to their names, and remove its folder; may be repeated."""
    manifest = spark.read.schema("name string, staged string").parquet(f"{staging}/manifest")
    # A move is a call to a remote store: as many at a time as there are cores.
    tasks = max(spark.sparkContext.defaultParallelism, manifest.count() // 10_000)
    moved = manifest.repartition(tasks, "name").mapInArrow(_moved(staging), "name string")
    moved.write.format("noop").mode("overwrite").save()
    _remove(*open_fs(staging))


def _staged(staging: str):
    """Write captions below the folder of one attempt at a task; (name, path below the staging folder) of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(staging)
        attempt, made = uuid.uuid4().hex, set()
        try:
            for batch in batches:
                names = [f"{name}.txt" for name in batch.column(0).to_pylist()]
                for name, caption in zip(names, batch.column(1).to_pylist(), strict=True):
                    target = safe_join(f"{root}/{attempt}", name)
                    _make_parent(system, target, made)
                    with system.open_output_stream(target) as out:
                        out.write(caption.encode("utf-8"))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([f"{attempt}/{n}" for n in names], pa.string())], ["name", "staged"])
        except BaseException:
            _remove(system, f"{root}/{attempt}")
            raise
    return run


def _moved(staging: str):
    """Move staged files to their names. A file that is no longer staged was moved by an earlier attempt."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(staging)
        made, folder = set(), root.rsplit("/", 1)[0]
        for batch in batches:
            for name, staged in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target, source = safe_join(folder, name), f"{root}/{staged}"
                _make_parent(system, target, made)
                if system.get_file_info(source).type == pafs.FileType.File:
                    system.move(source, target)
                elif system.get_file_info(target).type != pafs.FileType.File:
                    raise FileNotFoundError(f"neither {source} nor {target} is there")
            yield batch.select(["name"])
    return run


def _make_parent(system: pafs.FileSystem, target: str, made: set[str]) -> None:
    parent = target.rsplit("/", 1)[0]
    if parent not in made:
        system.create_dir(parent, recursive=True)
        made.add(parent)


def write_caption_table(df: DataFrame, folder: str, name: str = "name", caption: str = "caption") -> None:
    """The same pairs as a Parquet table, for numbers of captions that no folder should hold as files."""
    require(df, name, caption)
    df.select(F.col(name).cast("string").alias("name"), F.col(caption).cast("string").alias("caption")).write.mode("overwrite").parquet(to_uri(folder))


def _remove(system: pafs.FileSystem, folder: str) -> None:
    if system.get_file_info(folder).type == pafs.FileType.Directory:
        system.delete_dir(folder)


def safe_join(root: str, member: str) -> str:
    """`root`/`member`, refusing names that would leave the folder."""
    if unsafe_member(member):
        raise ValueError(f"unsafe name {member!r}")
    return f"{root.rstrip('/')}/{member}"


def unsafe_member(member: str) -> bool:
    parts = member.replace("\\", "/").split("/")
    return member.startswith(("/", "\\")) or ".." in parts or (len(parts[0]) > 1 and parts[0][1] == ":")
