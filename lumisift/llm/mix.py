"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumisift.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
# Documents of a source are ordered inside ranges of their hash, so that no task orders a
# whole source; times of arrival are totalled in ranges too.
SLICES = 4096
TICKS = 1 << 16


def word_count(text: Column | str) -> Column:
    """Number of words: runs of other than the six white-space characters; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float, repeats: float) -> DataFrame:
    """Add `target` to sources(weight, size): `share` of all sizes dealt by weight.

    A source takes `repeats` times its size at most; what is over is dealt again to the
    others by weight, until none is above. All that grows with the number of sources
    stays in the table; a round brings back three numbers.
    """
    sources = sources.withColumn("most", F.lit(float(repeats)) * F.col("size"))
    total, = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()
    budget, level = share * total, 0.0
    while True:
        # Sources that a level (words per weight) fills stay filled at any higher level.
        full = F.col("most") <= F.lit(level) * F.col("weight")
        taken, weights = sources.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)),
                                     F.sum(F.when(~full, F.col("weight")))).first()
        if not weights:
            break
        now = (budget - taken) / weights
        if now <= level:
            break
        level = now
    return sources.withColumn("target", F.least("most", F.lit(level) * F.col("weight"))).drop("most")


def fair_mix(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             share: float = 1.5, repeats: int = 2, seed: int = 17, keep_source: bool = False) -> DataFrame:
    """(id_col, size, source_size, target, taken) for every document, and its source with `keep_source`.

    Sources in code point order, null last, have the weights of the list in turn. Each
    source's documents are shuffled by a hash of their id and queue up `repeats` times.
    A document's virtual finish time is the number of words its source has sent with
    it, divided by the source's target; documents are taken by finish time over all
    sources until the budget, `share` of all words, is reached. The last document may
    go over it. `taken` is the document's words times the number of passes that take it.

    The shuffle depends on ids alone, so a rerun gives the same mix. Rows that repeat an
    id and size share a place in the queue: each is counted, and all or none are taken
    in a pass. A null id is shuffled like the text "null"; a null text has size 0 and
    takes nothing. Without words at all every target is 0.
    """
    scratch = Scratch(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
                        word_count(text_col).alias("size"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    rows = scratch.cut(named.withColumn("key", key), "sizes")
    slices = (rows.withColumn("slice", F.substring("key", 1, 3)).groupBy("source", "slice")
              .agg(F.sum("size").alias("words")))
    slices = scratch.cut(slices, "slices")
    by_source = slices.groupBy("source").agg(F.sum("words").alias("size"))
    # One row per source: few enough to number in one task.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = scratch.cut(by_source.withColumn("weight", cycle[place % len(weights)]), "sources")
    sources = targets(sources, share, repeats)

    # Words sent before each slice of a source, then before each document of a slice.
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (slices.withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0)))
               .withColumnRenamed("source", "s").join(sources.select(F.col("source").alias("s2"), F.col("size").alias("source_size"), "target"),
                                                      F.col("s").eqNullSafe(F.col("s2"))).drop("s2", "words")
               .withColumnRenamed("slice", "p"))
    placed = (rows.withColumn("slice", F.substring("key", 1, 3))
              .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("p"))))
    upto = Window.partitionBy("source", "slice").orderBy("key", "id", "size")
    queued = placed.withColumn("sent", F.col("ahead") + F.sum("size").over(upto))
    queued = scratch.cut(queued.select("id", "source", "size", "source_size", "target", "key", "sent"), "queue")

    budget = share * (sources.agg(F.sum("size")).first()[0] or 0)
    # Copies of a document in the queue, one per pass; a source without words has none.
    finish = [((F.lit(p) * F.col("source_size") + F.col("sent")) / F.col("target")) for p in range(repeats)]
    copies = queued.filter("size > 0").select("size", F.posexplode(F.array(*finish)).alias("pass", "finish"), "key", "source")
    cut_at = _cut(copies, budget)
    taken = F.lit(0)
    for p in range(repeats):
        if cut_at is not None:
            time, last = cut_at
            taken = taken + F.when(F.struct(finish[p], F.col("key"), F.lit(p)) <= F.struct(F.lit(time), F.lit(last[0]), F.lit(last[1])), F.col("size")).otherwise(F.lit(0))
    named = [F.col("source").alias(source_col)] if keep_source else []
    return queued.select(F.col("id").alias(id_col), *named, "size", "source_size", "target",
                         F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long").alias("taken"))


def _cut(copies: DataFrame, budget: float) -> tuple[float, tuple[str, int]] | None:
    """Finish time and (key, pass) of the last copy taken; None if there is none."""
    # Every source reaches its target at time 1, and no pass ends after the last one.
    tick = F.floor(F.col("finish") * TICKS).cast("long")
    ticks = copies.groupBy(tick.alias("tick")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.orderBy("tick"))
    running = ticks.withColumn("upto", upto)
    crossing = running.filter(F.col("upto") >= budget).orderBy("tick").first()
    if crossing is None:
        last = copies.orderBy(F.desc("finish"), F.desc("key"), F.desc("pass")).first()
        return None if last is None else (last["finish"], (last["key"], last["pass"]))
    # The copies of one tick in order, up to the one that reaches the budget.
    here = copies.filter(tick == crossing["tick"])
    order = Window.orderBy("finish", "key", "pass")
    sent = here.withColumn("upto", F.sum("size").over(order) + F.lit(crossing["upto"] - crossing["words"]))
    last = sent.filter(F.col("upto") >= budget).orderBy("finish", "key", "pass").first()
    return last["finish"], (last["key"], last["pass"])
