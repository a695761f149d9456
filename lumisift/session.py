"""Session settings and the shared folder that iterative jobs cut lineage into."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution splits skewed join partitions and merges small ones at run
# time, so no operator here hard-codes a partition count.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Image datasets are many small files: let a task take some two thousand of them.
    "spark.sql.files.openCostInBytes": str(64 * 1024),
    # Decoded images are megabytes each: batches to Python are bounded by bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 * 1024 * 1024),
}


_shipped: set[str] = set()
_fallbacks: dict[str, str] = {}


def session(app: str = "lumisift", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers, once per application.

    Functions that run in tasks import it there. An installed package, or one passed
    with `--py-files`, needs no shipping; doing it anyway is harmless.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="lumisift-"), "lumisift")
        context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by `spark.checkpoint.dir`.

    Only a local master may fall back to a temporary folder: on a cluster such a
    folder is private to one machine and is lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    # A running session does not take this setting any more, so the folder is kept here.
    app = spark.sparkContext.applicationId
    if app not in _fallbacks:
        _fallbacks[app] = tempfile.mkdtemp(prefix="lumisift-")
    return _fallbacks[app]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path for this application below the shared folder."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def scratch_dir(spark: SparkSession) -> str:
    """Where this application keeps intermediate tables; free to delete once it has ended."""
    return f"{shared_dir(spark)}/lumisift-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, label: str = "table", codec: str = "snappy") -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and go on from there.

    Later stages read only the columns they use, know the table's size, and do not
    recompute its lineage when an executor is lost.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for path in {os.path.dirname(file) for file in table.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        # Spark deletes the files of shuffles that are done with when the driver collects garbage.
        spark._jvm.System.gc()


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: keeps partitions and the order of rows inside them."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
