"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> documents that go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm import classify, decontaminate, mix, near, repeats
from lumisift.llm.common import Scratch, few, table
from lumisift.session import ship


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of `docs` whose keys, all columns of the written table `gone`, are not in it; a null is a key like others."""
    gone = few(gone)
    same = F.lit(True)
    for c in gone.columns:
        same = same & docs[c].eqNullSafe(gone[c])
    return docs.join(gone, same, "left_anti")


def row_keys(docs: DataFrame) -> list[Column]:
    """128 bits that two rows share only if id, text, source and language are equal."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00\x00")) for c in ("doc_id", "source", "lang", "text")]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def recounted(docs: DataFrame) -> DataFrame:
    """`docs` with n_chars, where there is one, as long as the text now is."""
    if "n_chars" not in docs.columns:
        return docs
    kind = dict(docs.dtypes)["n_chars"]
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for poor or toxic go, whatever their id; verdicts are by row."""
    labels = table(spark, sf_dir, "labels")
    scratch = Scratch(spark)
    scored = classify.quality(docs, labels, row=row_keys(docs))
    rejected = scratch.cut(scored.filter("NOT kept").select(F.col("row_0").alias("_a"), F.col("row_1").alias("_b")).distinct(), "rejected")
    a, b = row_keys(docs)
    return without(docs.withColumns({"_a": a, "_b": b}), rejected).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the lowest id.

    Groups are over five-word shingles at a similarity of 0.8. Rows without an id, and
    rows that share one, are documents of their own after all others; of rows that are
    equal in id, text, source and language one stays.
    """
    ship(spark)
    scratch = Scratch(spark)
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 OR doc_id IS NULL")
    shared = scratch.cut(shared.select(F.col("doc_id").alias("_id")), "shared")
    if shared.isEmpty():
        return without(docs, scratch.cut(near.near_duplicates(docs.select("doc_id", "text")).filter("NOT kept").select("doc_id").distinct(), "dropped"))
    # Above all ids that are numbers of documents; equal rows get equal numbers.
    own = F.shiftrightunsigned(row_keys(docs)[0], 2).bitwiseOR(F.lit(1 << 62))
    marked = docs.join(few(shared).withColumn("_many", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    marked = marked.withColumn("_row", F.when(F.col("_many"), own).otherwise(F.col("doc_id"))).select(*docs.columns, "_row", "_many")
    found = near.near_duplicates(marked.select("_row", "text"), id_col="_row")
    kept = without(marked, scratch.cut(found.filter("NOT kept").select("_row").distinct(), "dropped"))
    once = kept.filter("_many").dropDuplicates(["_row"])
    return kept.filter("_many IS NULL").unionByName(once).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that are found more than once are cut out of all texts; all rows stay."""
    ship(spark)
    return recounted(repeats.without_passages(docs, "text", 200))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 10 words of benchmark items are cut out; documents more than half of which they cover go."""
    return recounted(decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"), "text", 10, 0.5))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: the documents that it takes, whole, with `size`, `source_size`, `target`, `taken` and `times`.

    A document is `times` times in the mix, which takes `taken` words of it in all; those
    that it does not take go. Rows equal in id, source and size are taken alike.
    """
    ship(spark)
    scratch = Scratch(spark)
    figures = ["size", "source_size", "target", "taken"]
    mixed = mix.fair_mix(docs, weights=[3, 1, 2], keep_source=True).filter("taken > 0").distinct()
    mixed = scratch.cut(mixed.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), *[F.col(c).alias(f"_{c}") for c in figures]), "mixed")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (mix.word_count("text") == F.col("_size"))
    plain = [c for c in docs.columns if c not in (*figures, "times")]
    return (docs.select(*plain).join(mixed, same)
            .select(*plain, *[F.col(f"_{c}").alias(c) for c in figures], F.expr("_taken div _size").cast("int").alias("times")))
