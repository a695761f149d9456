"""Index snapshots and clustered sets as partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.operators.index import diff_index, next_snapshot
from lumisift.schemas import require


def current_version(spark: SparkSession, folder: str) -> int:
    """Latest committed version of an index, 0 when there is none."""
    try:
        versions = spark.read.schema("version bigint").parquet(f"{folder}/versions")
    except Exception as e:  # a missing folder is an index without versions
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise
    return versions.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def read_index(spark: SparkSession, folder: str) -> DataFrame | None:
    version = current_version(spark, folder)
    return spark.read.parquet(f"{folder}/snapshot-{version:08d}") if version else None


def write_index(df: DataFrame, folder: str) -> int:
    """Write the next snapshot and then commit it. A table being read is never overwritten.

    The snapshot has its own folder and the commit is one appended row, so a failed
    job leaves the last version in force.
    """
    spark = df.sparkSession
    version = current_version(spark, folder) + 1
    df.write.mode("overwrite").parquet(f"{folder}/snapshot-{version:08d}")
    spark.createDataFrame([(version,)], "version bigint").coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return version


def refresh_index(scan: DataFrame, folder: str) -> DataFrame:
    """Compare a scan with the stored index, commit the next snapshot, return the changes."""
    require(scan, "path", "length", "mtime")
    spark = scan.sparkSession
    prior = read_index(spark, folder)
    if prior is None:
        prior = spark.createDataFrame([], scan.schema)
    changes = diff_index(prior, scan)
    version = current_version(spark, folder) + 1
    # Written once and read back: the scan is not repeated for the snapshot.
    changes.write.mode("overwrite").parquet(f"{folder}/changes-{version:08d}")
    changes = spark.read.parquet(f"{folder}/changes-{version:08d}")
    write_index(next_snapshot(changes), folder)
    return changes


def write_by_cluster(df: DataFrame, folder: str, cluster: str = "cluster", id_col: str = "id",
                     rows_per_file: int = 1_000_000) -> None:
    """Save a classified set as a table partitioned by cluster.

    Rows are spread by (cluster, slice), with as many slices as the cluster's size
    asks for, so a cluster holding a third of all rows is written by many tasks.
    """
    require(df, cluster, id_col)
    sizes = (df.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"))
             .select(cluster, F.ceil(F.col("_n") / rows_per_file).cast("int").alias("_slices")))
    n_clusters, slices = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("_slices"), F.lit(1))).first()
    if n_clusters > 100_000:
        raise ValueError(f"{n_clusters} clusters are too many folders for a partitioned table")
    sliced = (df.join(F.broadcast(sizes.filter("_slices > 1")), cluster, "left")
              .withColumn("_slice", F.coalesce(F.pmod(F.xxhash64(id_col), F.col("_slices")), F.lit(0))))
    tasks = max(1, min(int(slices), 100_000))
    (sliced.repartition(tasks, cluster, "_slice").drop("_slice", "_slices")
     .write.mode("overwrite").partitionBy(cluster).parquet(folder))
