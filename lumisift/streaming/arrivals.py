"""New files as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumisift.sources.files import to_uri

# Fixed schema of Spark's binaryFile source.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arrivals(spark: SparkSession, root: str, glob: str = "*", max_files: int = 100_000) -> DataFrame:
    """Streaming files(path, root, length, mtime): each file below `root` once, as it appears.

    The source remembers what it has seen in the query's checkpoint. Contents are
    not read. Deletions never show up in a stream: they need `diff_index`.
    """
    uri = to_uri(root)
    found = (spark.readStream.format("binaryFile").schema(BINARY_FILE)
             .option("recursiveFileLookup", True).option("pathGlobFilter", glob)
             .option("maxFilesPerTrigger", max_files).load(uri))
    return found.select("path", F.lit(uri).alias("root"), "length", F.col("modificationTime").alias("mtime"))


def index_arrivals(spark: SparkSession, root: str, table: str, checkpoint: str, glob: str = "*",
                   each_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Write everything that has arrived so far to the Parquet table `table`, then stop.

    A batch goes to its own folder, overwritten when the batch is retried, so a
    restart after a failure neither loses nor doubles a file.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        if each_batch is not None:
            each_batch(spark.read.parquet(f"{table}/batch={batch_id}"), batch_id)

    return (arrivals(spark, root, glob).writeStream.foreachBatch(save)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
