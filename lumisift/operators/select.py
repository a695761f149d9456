"""Choosing images: by tags, by number, in batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumisift.functions.tags import tags_match
from lumisift.schemas import require
from lumisift.session import pin

# Up to here the first n rows fit one task with ease; above it they are ranked.
SMALL_N = 100_000


def select_by_tags(df: DataFrame, all_of: Sequence[str] = (), any_of: Sequence[str] = (),
                   none_of: Sequence[str] = (), tags: str = "tags") -> DataFrame:
    """Rows whose tag array passes the test. Narrow: no shuffle."""
    require(df, tags)
    return df.filter(tags_match(F.col(tags), all_of, any_of, none_of))


def select_by_tag_rows(df: DataFrame, tag_rows: DataFrame, all_of: Sequence[str] = (),
                       any_of: Sequence[str] = (), none_of: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """The same test against a table `tag_rows(id, tag)`.

    Only rows of the wanted tags leave the scan (an `IN` filter that Parquet can
    push down), and each id reaches the join as one pre-aggregated row.
    """
    require(df, id_col)
    require(tag_rows, "id", "tag")
    all_of, any_of, none_of = (list(dict.fromkeys(x)) for x in (all_of, any_of, none_of))
    out = df
    if all_of or any_of:
        tests = [F.max(F.col("tag") == t) for t in all_of]
        if any_of:
            tests.append(F.max(F.col("tag").isin(any_of)))
        keep = (tag_rows.filter(F.col("tag").isin(all_of + any_of)).groupBy("id")
                .agg(*[t.alias(f"_t{i}") for i, t in enumerate(tests)]))
        for i in range(len(tests)):
            keep = keep.filter(F.col(f"_t{i}"))
        out = out.join(keep.select(F.col("id").alias(id_col)), id_col, "left_semi")
    if none_of:
        gone = tag_rows.filter(F.col("tag").isin(none_of)).select(F.col("id").alias(id_col))
        out = out.join(gone, id_col, "left_anti")
    return out


def take_n(df: DataFrame, n: int, order_by: Sequence[str | Column] = ("id",)) -> DataFrame:
    """The first `n` rows, in order. The order should end in a unique column.

    However large `n` is the rows come sorted; beyond SMALL_N they are ranked by a range
    sort, so that no task holds them all.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    if n <= SMALL_N:
        return df.orderBy(*order_by).limit(n)
    return rank_rows(df, order_by, "_rank").filter(F.col("_rank") < n).orderBy("_rank").drop("_rank")


def assign_batches(df: DataFrame, unit: int = 100, order_by: Sequence[str | Column] = ("id",),
                   out: str = "batch") -> DataFrame:
    """Number the rows in groups of `unit`, in order, from batch 0."""
    if not 1 <= unit <= 100:
        raise ValueError("unit must be between 1 and 100")
    return (rank_rows(df, order_by, "_rank")
            .withColumn(out, F.floor(F.col("_rank") / unit).cast("bigint")).drop("_rank"))


def rank_rows(df: DataFrame, order_by: Sequence[str | Column], out: str) -> DataFrame:
    """Global 0-based rank without a single-partition window.

    The range-sorted rows are written once, so that a lost task recomputes neither
    the sort nor different partition bounds. Row numbers inside a partition come
    from `monotonically_increasing_id` (partition id above bit 33, row below), and
    partition offsets from one count per partition.
    """
    ordered = pin(df.orderBy(*order_by)).withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftright("_mid", 33).alias("_part")
    row = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition of the sorted data: a few thousand at most.
    counts = ordered.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (ordered.withColumn("_part", part)
            .join(F.broadcast(offsets), "_part")
            .withColumn(out, F.col("_offset") + row)
            .select(*df.columns, out))
