import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumisift.operators import batch, clusters, features
from lumisift.plans import skew
from lumisift.sources import tables


def points(n=120, k=4, dims=3, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((k, dims)) * 8
    label = rng.integers(0, k, n)
    return label, centres[label] + rng.standard_normal((n, dims))


@pytest.fixture(scope="module")
def cloud(spark):
    label, x = points()
    rows = [(i, int(c), [float(v) for v in p]) for i, (c, p) in enumerate(zip(label, x))]
    return spark.createDataFrame(rows, "id bigint, label int, features array<double>")


@pytest.mark.parametrize("method", ["lloyd", "kmeans", "bisecting"])
def test_fit(spark, cloud, method):
    centroids = clusters.fit_clusters(cloud, 4, method)
    assert centroids.count() == 4
    assigned = clusters.assign_clusters(cloud, centroids)
    assert assigned.count() == 120 and set(assigned.columns) == {*cloud.columns, "cluster", "distance"}
    assert -1 <= clusters.silhouette(assigned) <= 1
    total = clusters.cluster_purity(assigned).agg(F.sum("rows"), F.sum("majority")).first()
    assert total[0] == 120 and total[1] >= 30


def test_lloyd_is_repeatable(spark, cloud):
    start = cloud.filter("id < 4").select(F.col("id").cast("int").alias("cluster"), F.col("features").alias("centroid"))
    results = [sorted(tuple(map(tuple, (r["centroid"], [r["cluster"]]))) for r in
                      clusters.fit_clusters(cloud.repartition(p), 4, "lloyd", start, 5).collect()) for p in (1, 3, 8)]
    assert results[0] == results[1] == results[2]


def test_empty_cluster_keeps_its_centroid_and_ties_go_low(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [2.0]), (3, None)], "id int, features array<double>")
    start = spark.createDataFrame([(0, [0.0]), (1, [2.0]), (2, [99.0])], "cluster int, centroid array<double>")
    fitted = {r["cluster"]: r["centroid"] for r in clusters.fit_clusters(df, 3, "lloyd", start, 3).collect()}
    assert fitted == {0: [0.0], 1: [2.0], 2: [99.0]}
    tie = spark.createDataFrame([(1, [1.0]), (2, None)], "id int, features array<double>")
    assert [(r["cluster"], r["distance"]) for r in clusters.assign_clusters(tie, start).orderBy("id").collect()] == [(0, 1.0), (None, None)]


def test_summary(spark, cloud):
    assigned = clusters.assign_clusters(cloud, clusters.mean_centroids(cloud, "label"))
    tag_rows = cloud.select("id", F.concat(F.lit("t"), F.col("label").cast("string")).alias("tag"))
    pdf = assigned.toPandas()
    for r in clusters.cluster_summary(assigned, 3, tag_rows).collect():
        mine = pdf[pdf.cluster == r["cluster"]]
        assert r["size"] == len(mine)
        assert r["nearest"] == list(mine.sort_values(["distance", "id"]).id[:3])
        assert r["top_tags"][0] == "t" + str(mine.label.mode().min())


def test_best_k(spark, cloud):
    got = {r["k"]: r["silhouette"] for r in clusters.best_k(cloud, [2, 4], method="kmeans").collect()}
    assert set(got) == {2, 4}


def test_write_by_cluster_splits_the_large_one(spark, tmp_path):
    df = spark.range(3000).select("id", F.when(F.col("id") < 1000, F.lit(1)).otherwise(F.col("id") % 7 + 2).cast("int").alias("cluster"))
    tables.write_by_cluster(df, str(tmp_path / "out"), rows_per_file=250)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.select("id", "cluster").collect()) == sorted(tuple(r) for r in df.collect())
    assert len(list((tmp_path / "out" / "cluster=1").glob("*.parquet"))) >= 2


def test_tfidf_forms_agree(spark):
    rows = [(1, ["a", "b", "a"]), (2, ["a"]), (3, ["c", "b"]), (4, []), (5, None)]
    df = spark.createDataFrame(rows, "id int, tags array<string>")
    long = {(r["id"], r["tag"]): round(r["weight"], 9) for r in features.tfidf_features(df).collect()}
    salted = {(r["id"], r["tag"]): round(r["weight"], 9) for r in features.tfidf_features(df, rows_per_slice=0).collect()}
    assert long == salted and set(long) == {(1, "a"), (1, "b"), (2, "a"), (3, "b"), (3, "c")}
    known = df.filter("id < 5")
    dense = {r["id"]: r["features"].toArray() for r in features.tfidf_vectors(known).collect()}
    mine = {(r["id"], r["tag"]): r["weight"] for r in features.tfidf_features(known).collect()}
    assert sorted(round(v, 9) for v in dense[3] if v) == sorted(round(mine[k], 9) for k in mine if k[0] == 3)


def test_unit_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id int, v array<float>")
    got = {r["id"]: r["features"] for r in features.vector_features(df, "v").collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] is None and got[3] is None


def test_salted_join_equals_plain_join(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("k"))
    counted = rows.groupBy("k").count()
    lookup = counted.filter("k <> '7'").select("k", F.upper("k").alias("v"))
    heavy = skew.heavy_keys(counted, "k", "count", 100, 2000)
    assert [r["k"] for r in heavy.collect()] == ["hot"]
    for how in ("inner", "left"):
        a = skew.salted_join(rows, lookup, "k", F.xxhash64("id"), heavy, how).select("id", "k", "v")
        assert sorted(map(str, a.collect())) == sorted(map(str, rows.join(lookup, "k", how).select("id", "k", "v").collect()))


def test_batch_model(spark):
    df = spark.range(500).select("id", F.col("id").cast("string").alias("t")).repartition(3)

    def good(frames):
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "n": f["t"].str.len()})

    def lossy(frames):
        for f in good(frames):
            yield f.iloc[1:]

    assert batch.infer_batch(df, good, "id bigint, n bigint").filter("n = 3").count() == 400
    with pytest.raises(Exception, match="model returned"):
        batch.infer_batch(df, lossy, "id bigint, n bigint").count()


def test_strips_change_nothing():
    import numpy as np

    from lumisift.functions.vectors import nearest_rows, squared_distances

    rng = np.random.default_rng(2)
    x, c = rng.integers(0, 4, (50, 3)).astype(float), rng.integers(0, 4, (700, 3)).astype(float)
    d = squared_distances(x, c)
    at, least = nearest_rows(x, c, strip_bytes=8 * 256 * 5)
    assert (at == d.argmin(1)).all() and (least == d.min(1)).all()


def test_a_vocabulary_is_not_cut_off(spark):
    from lumisift.operators import features

    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"])], "id int, tags array<string>")
    with pytest.raises(ValueError, match="3 different tags"):
        features.tfidf_vectors(df, vocabulary=1)
    a, b = features.tfidf_vectors(df).orderBy("id").collect()
    assert a["features"] != b["features"]
