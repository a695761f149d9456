"""Reading tables, intermediate tables and Arrow helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.session import fresh_dir, ship

# Texts are joined and worked on in pieces of about this many bytes.
PIECE = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Arrow batches are bounded in rows, as a text may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables of one operator, in the shared folder; dropped when no longer read.

    A table written here cuts the lineage: what follows survives the loss of any
    executor without going back to the input.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        path = fresh_dir(self.spark, label)
        df.write.option("compression", "zstd").parquet(path)
        # Shuffles behind the table are done with; Spark deletes their files when the driver collects garbage.
        self.spark._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep = getattr(self, "_keep", []) + [out]
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no frame still to be run reads."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def few(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Mark a written table of ids for broadcast if it is counted to be within `most` rows.

    A million numbers take some 16 MB in a task. Beyond that Spark joins by shuffle.
    """
    return F.broadcast(ids) if ids.count() <= most else ids


def by_row(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply `fn` to every Arrow batch of `df`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield out
    return df.mapInArrow(run, schema)


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
