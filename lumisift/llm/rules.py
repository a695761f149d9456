"""Rules on whole texts and a log-likelihood ratio of hashed n-grams. DataFrame functions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import Scratch, few

SPACE = " \t\n\x0b\x0c\r"
BUCKETS = 1 << 16
ADDED = 5.0
MICRO = 1_000_000  # weights are whole millionths: sums are the same in any order


def words(text: Column) -> Column:
    """Runs of other than the six white-space characters; none for null."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _next(h: Column, other: Column, skip: int) -> Column:
    """Hash of each item of `h` with the item of `other` that begins `skip` places later."""
    n = F.greatest(F.size(other) - skip, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(other, skip + 1, n), lambda a, b: F.xxhash64(a, b))


def _placed(h: Column) -> Column:
    """(hash, place) of all windows in order of the hash, or null if no hash is found twice."""
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    return F.when(F.size(h) > F.size(F.array_distinct(h)), F.sort_array(pairs))


def _covered(placed: Column, width: int) -> Column:
    """Number of places in windows whose hash is found twice or more; `placed` is a column of its own, as it is read often."""
    n = F.size(placed)
    equal = F.zip_with(F.slice(placed, 1, n - 1), F.slice(placed, 2, n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda p: p.isNotNull()))))
    # Windows in order of place: each adds what the one before has not covered.
    return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last")),
                       lambda s, i: F.struct((s["n"] + F.least(F.lit(width), i - s["last"])).cast("long").alias("n"), i.alias("last")),
                       lambda s: s["n"])


def rule_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add h1, h2 (hashes of words and word pairs) and the counts the rules go by."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    with_words = docs.withColumn("w", words(text)).withColumn("h1", _hashes(F.col("w"))).withColumn("h2", _next(F.col("h1"), F.col("h1"), 1))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    counted = with_words.withColumn("h3", _next(F.col("h2"), F.col("h1"), 2)).withColumn("placed", _placed(F.col("h3"))).withColumn("lines", lines)
    repeated = F.when(F.col("placed").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.col("placed"), 3))
    return counted.withColumns({
        "n_words": F.size("w").cast("long"), "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), "n_repeat_words": repeated,
    }).drop("w", "h3", "placed", "lines")


def _buckets() -> Column:
    """Buckets of all single words and word pairs of a text."""
    return F.transform(F.concat("h1", "h2"), lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))


def weights(docs: DataFrame, trusted: DataFrame) -> list[int]:
    """Millionths of log(p / q) per bucket: p over the trusted texts, q over all texts.

    docs(id, text); trusted(id) is a written table of any number of ids, each once, sent to
    all tasks only while they are few. Both multinomials are taken at the total of the trusted one, with ADDED in every bucket: what is seen a
    few times only says little either way. Counts are summed in the tasks first, so what is
    shuffled and brought back is one row per bucket.
    """
    marked = docs.join(few(trusted).select("id", F.lit(1).alias("trusted")), "id", "left")
    h1 = _hashes(words(F.col("text")))
    hashed = marked.select("trusted", h1.alias("h1")).withColumn("h2", _next(F.col("h1"), F.col("h1"), 1))
    rows = (hashed.select("trusted", F.explode(_buckets()).alias("bucket")).groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target")))
    counts = {r.bucket: (r.raw, r.target) for r in rows.collect()}  # at most BUCKETS rows
    raw, target = (sum(c[k] for c in counts.values()) for k in (0, 1))
    scale = target / max(raw, 1)
    return [round(MICRO * math.log((t + ADDED) / (r * scale + ADDED))) for r, t in (counts.get(b, (0, 0)) for b in range(BUCKETS))]


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = -0.1,
                  bucket_weights: list[int] | None = None) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept) per document.

    base_failed: fewer than 50 words, or more than half of the words in three-word runs
    found again in the text. `ratio` is the log-likelihood ratio of the text's words and
    word pairs, hashed to buckets, between trusted texts (labelled good and not toxic)
    and all texts, per n-gram; a document is kept if it does not fail the base rules and
    its ratio is at least `threshold`. Weights and sums are whole millionths, so the
    verdict on a text is the same in every run.

    Null and empty texts have no words and fail. Rows that repeat an id each count and
    get a row. Without trusted labels only the base rules decide.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    if bucket_weights is None:
        per_id = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        good = per_id.filter("q = 1 AND coalesce(t, 0) = 0 AND id IS NOT NULL").select("id")
        good = Scratch(docs.sparkSession).cut(good, "trusted")
        bucket_weights = [0] * BUCKETS if good.isEmpty() else weights(plain, good)
    # A constant array: 65,536 numbers in the plan, read by place.
    table = F.from_json(F.lit(json.dumps(bucket_weights)), "array<bigint>")
    counted = rule_counts(plain)
    total = F.aggregate(_buckets(), F.lit(0).cast("long"), lambda s, b: s + F.get(table, b))
    out = counted.withColumn("total", total).withColumn("n_grams", F.size("h1") + F.size("h2"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fits = F.col("total") >= F.lit(round(threshold * MICRO)).cast("long") * F.col("n_grams")
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (F.col("total") / F.greatest("n_grams", F.lit(1)) / MICRO).alias("ratio"),
                      (~failed & fits).alias("kept"))
