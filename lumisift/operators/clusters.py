"""Learning, assigning, judging and describing clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumisift.functions.vectors import matrix, nearest_rows
from lumisift.operators.features import ml_vectors
from lumisift.schemas import require
from lumisift.session import cut

# Centroids are a parameter of the user's choice and travel with the task code.
MAX_CENTROIDS = 65_536
MAX_CENTROID_BYTES = 256 << 20  # all centroids as doubles, on the driver and in every task
CENTROIDS = "cluster int, centroid array<double>"


def fit_clusters(df: DataFrame, k: int, method: str = "lloyd", init: DataFrame | None = None, rounds: int = 10,
                 features: str = "features", id_col: str = "id", seed: int = 17) -> DataFrame:
    """Learn `k` centroids: (cluster, centroid).

    `lloyd` starts from `init(cluster, centroid)`, or from the k rows of lowest id
    hash, and is repeatable on any partitioning. `kmeans` and `bisecting` are the
    ML estimators, whose cluster numbers depend on the layout of the input.
    """
    require(df, features)
    if not 1 <= k <= MAX_CENTROIDS:
        raise ValueError(f"k must lie between 1 and {MAX_CENTROIDS}")
    spark = df.sparkSession
    if method == "lloyd":
        if init is None:
            chosen = (df.select(F.col(features).alias("v"), F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i"))
                      .orderBy("h", "i").limit(k).collect())
            start = np.array([r["v"] for r in chosen], dtype=np.float64)
        else:
            start = _centroid_matrix(init)
        return _centroid_frame(spark, _lloyd(df, start, rounds, features))
    estimators = {"kmeans": KMeans, "bisecting": BisectingKMeans}
    if method not in estimators:
        raise ValueError(f"unknown method {method!r}")
    model = estimators[method](k=k, maxIter=rounds, seed=seed, featuresCol="_vector").fit(ml_vectors(df, features))
    return _centroid_frame(spark, np.array(model.clusterCenters()))


def _lloyd(df: DataFrame, centroids: np.ndarray, rounds: int, features: str) -> np.ndarray:
    """Rounds of assign and mean. Each task sends one row of sums per cluster."""
    data, dims = cut(df.select(features), "features"), centroids.shape[1]
    schema = "cluster int, n bigint, " + ", ".join(f"s{i} double" for i in range(dims))
    for _ in range(rounds):
        partial = data.mapInPandas(_partial_sums(centroids.copy(), features), schema)
        sums = (partial.groupBy("cluster")
                .agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(dims)]).collect())
        updated = centroids.copy()  # an empty cluster keeps its centroid
        for row in sums:
            updated[row["cluster"]] = np.round([row[f"s{i}"] / row["n"] for i in range(dims)], 9)
        if np.array_equal(updated, centroids):
            break
        centroids = updated
    return centroids


def _partial_sums(centroids: np.ndarray, features: str):
    k, dims = centroids.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims))
        for batch in batches:
            known = batch[features].dropna()
            if len(known) == 0:
                continue
            x = matrix(known)
            nearest, _ = nearest_rows(x, centroids)
            n += np.bincount(nearest, minlength=k)
            np.add.at(sums, nearest, x)
        used = np.flatnonzero(n)
        out = pd.DataFrame(sums[used], columns=[f"s{i}" for i in range(dims)])
        out.insert(0, "n", n[used])
        out.insert(0, "cluster", used.astype(np.int32))
        yield out

    return run


def assign_clusters(df: DataFrame, centroids: DataFrame, features: str = "features") -> DataFrame:
    """Add `cluster` and `distance` (squared, 9 places) of the nearest centroid; ties to the lowest id.

    One narrow pass over the rows, whatever their number. A null vector gets nulls.
    """
    require(df, features)
    points, labels = _centroid_matrix(centroids, with_labels=True)

    @F.pandas_udf("cluster int, distance double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"cluster": pd.Series(pd.NA, index=vectors.index, dtype="Int32"),
                            "distance": pd.Series(np.nan, index=vectors.index)})
        known = vectors.dropna()
        if len(known):
            best, least = nearest_rows(matrix(known), points)
            out.loc[known.index, "cluster"] = labels[best]
            out.loc[known.index, "distance"] = least
        return out

    return (df.withColumn("_near", nearest(F.col(features)))
            .select(*df.columns, F.col("_near.cluster").alias("cluster"),
                    F.when(F.col("_near.cluster").isNotNull(), F.col("_near.distance")).alias("distance")))


def _centroid_matrix(centroids: DataFrame, with_labels: bool = False):
    """The k centroids, ordered by cluster. k is bounded, so they may come to the driver."""
    require(centroids, "cluster", "centroid")
    rows = centroids.select("cluster", "centroid").orderBy("cluster").limit(MAX_CENTROIDS + 1).collect()
    if not 1 <= len(rows) <= MAX_CENTROIDS:
        raise ValueError(f"need 1 to {MAX_CENTROIDS} centroids")
    if sum(len(r["centroid"]) for r in rows) * 8 > MAX_CENTROID_BYTES:
        raise ValueError(f"centroids of more than {MAX_CENTROID_BYTES} bytes")
    points = np.array([r["centroid"] for r in rows], dtype=np.float64)
    return (points, np.array([r["cluster"] for r in rows], np.int32)) if with_labels else points


def _centroid_frame(spark, points: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], CENTROIDS)


def mean_centroids(df: DataFrame, by: str, features: str = "features", places: int = 9) -> DataFrame:
    """Mean vector per value of an integer column, e.g. a known label: (cluster, centroid)."""
    require(df, by, features)
    summed = (df.select(F.col(by).cast("int").alias("cluster"), F.posexplode(features).alias("_i", "_x"))
              .groupBy("cluster", "_i").agg(F.round(F.avg(F.col("_x").cast("double")), places).alias("_m")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"])
    return summed.groupBy("cluster").agg(ordered.alias("centroid"))


def cluster_purity(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """Per cluster: labelled rows, rows of the commonest label, and their ratio."""
    require(df, label, cluster)
    counts = (df.filter(F.col(label).isNotNull() & F.col(cluster).isNotNull())
              .groupBy(cluster, label).agg(F.count(F.lit(1)).alias("_n")))
    return (counts.groupBy(cluster)
            .agg(F.sum("_n").alias("rows"), F.max("_n").alias("majority"))
            .withColumn("purity", F.col("majority") / F.col("rows")))


def silhouette(df: DataFrame, features: str = "features", cluster: str = "cluster") -> float:
    """Mean squared-Euclidean silhouette: linear in the rows, from one summary per cluster."""
    require(df, features, cluster)
    scored = ml_vectors(df.filter(F.col(cluster).isNotNull()), features)
    return ClusteringEvaluator(featuresCol="_vector", predictionCol=cluster).evaluate(scored)


def best_k(df: DataFrame, ks, features: str = "features", id_col: str = "id", **fit) -> DataFrame:
    """Silhouette per candidate k: (k, silhouette)."""
    rows = []
    for k in ks:
        centroids = fit_clusters(df, k, features=features, id_col=id_col, **fit)
        rows.append((int(k), float(silhouette(assign_clusters(df, centroids, features), features))))
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double")


def cluster_summary(df: DataFrame, top: int = 5, tag_rows: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """Per cluster: size, the `top` nearest members and, given tags, the `top` commonest tags.

    Ranks are filtered to `top` right where they are computed, so Spark keeps only
    that many rows of a cluster per task before any shuffle.
    """
    require(df, id_col, "cluster", "distance")
    # Three numbers a row, read three times: cheaper to keep than to assign again.
    members = cut(df.select(F.col(id_col).alias("id"), "cluster", "distance").filter(F.col("cluster").isNotNull()), "members")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    near = (members.withColumn("_r", F.row_number().over(Window.partitionBy("cluster").orderBy("distance", "id")))
            .filter(F.col("_r") <= top))
    out = sizes.join(near.groupBy("cluster").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", "id"))), lambda s: s["id"]).alias("nearest")), "cluster")
    if tag_rows is None:
        return out
    require(tag_rows, "id", "tag")
    counted = (tag_rows.select("id", "tag").distinct().join(members.select("id", "cluster"), "id")
               .groupBy("cluster", "tag").agg(F.count(F.lit(1)).alias("_n")))
    common = (counted.withColumn("_r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("_n"), "tag")))
              .filter(F.col("_r") <= top))
    tags = common.groupBy("cluster").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", "tag"))), lambda s: s["tag"]).alias("top_tags"))
    return out.join(tags, "cluster", "left")
