"""Feature vectors from array columns and from tags."""

from __future__ import annotations

from pyspark.ml.feature import IDF, CountVectorizer, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumisift.functions.vectors import unit
from lumisift.plans.skew import heavy_keys, salted_join
from lumisift.schemas import require
from lumisift.session import cut


def vector_features(df: DataFrame, col: str, out: str = "features") -> DataFrame:
    """Add the L2-normalised array of an array column; a zero vector gives null."""
    require(df, col)
    return df.withColumn(out, unit(F.col(col)))


def tfidf_features(df: DataFrame, id_col: str = "id", tags: str = "tags", normalise: bool = True,
                   rows_per_slice: int = 1_000_000) -> DataFrame:
    """TF-IDF in long form: (id, tag, tf, df, weight), weight = tf * ln((N + 1) / (df + 1)).

    No vocabulary is collected, so no tag is cut off. A tag on a third of all images
    is joined to its count in slices.
    """
    require(df, id_col, tags)
    tf = cut(df.select(F.col(id_col).alias("id"), F.explode(tags).alias("tag"))
             .groupBy("id", "tag").agg(F.count(F.lit(1)).cast("int").alias("tf")), "tf")
    df_counts = tf.groupBy("tag").agg(F.count(F.lit(1)).alias("df"))
    images = df.agg(F.count(F.lit(1)).alias("_all"))
    largest, total = df_counts.agg(F.max("df"), F.sum("df")).first()
    lookup = df_counts.select("tag", "df", F.log((images.scalar() + 1) / (F.col("df") + 1)).alias("_idf"))
    if (largest or 0) > rows_per_slice:
        heavy = heavy_keys(df_counts, "tag", "df", rows_per_slice, total)
        joined = salted_join(tf, lookup, "tag", F.xxhash64("id"), heavy)
    else:
        joined = tf.join(lookup, "tag")
    rows = joined.select("id", "tag", "tf", "df", (F.col("tf") * F.col("_idf")).alias("weight"))
    if not normalise:
        return rows
    # A window over one id holds the tags of one image only.
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id")))
    return (rows.withColumn("_norm", norm)
            .select("id", "tag", "tf", "df",
                    F.when(F.col("_norm") > 0, F.col("weight") / F.col("_norm")).otherwise(F.lit(0.0)).alias("weight")))


def tfidf_vectors(df: DataFrame, tags: str = "tags", out: str = "features", vocabulary: int = 1 << 20) -> DataFrame:
    """The same weights as sparse ML vectors, for estimators that need them.

    The vocabulary lives in the model, on the driver. No tag is cut off: more than
    `vocabulary` different tags raise an error; `tfidf_features` has no such bound.
    """
    require(df, tags)
    if (n := df.select(F.explode(tags).alias("tag")).distinct().count()) > vocabulary:
        raise ValueError(f"{n} different tags are above the bound of {vocabulary}; use tfidf_features")
    model = CountVectorizer(inputCol=tags, outputCol="_tf", vocabSize=vocabulary, minDF=1.0).fit(df)
    counted = model.transform(df)
    weighted = IDF(inputCol="_tf", outputCol="_w").fit(counted).transform(counted)
    return Normalizer(inputCol="_w", outputCol=out).transform(weighted).drop("_tf", "_w")


def ml_vectors(df: DataFrame, col: str = "features", out: str = "_vector") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(col)))
