"""Exact duplicates, and keeping the best member of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.functions.hashing import content_hash
from lumisift.plans.skew import broadcast_if_small
from lumisift.schemas import require
from lumisift.session import cut


def exact_duplicates(df: DataFrame, col: str, id_col: str = "id") -> DataFrame:
    """One row per repeated content: its hash, lowest id and number of rows.

    Only a 64-character hash and a number per distinct content are shuffled, after
    partial aggregation, so a content shared by a third of all rows costs no more
    than any other. Null content is never a duplicate.
    """
    require(df, col, id_col)
    return (df.select(content_hash(F.col(col)).alias("hash"), F.col(id_col).alias("id"))
            .filter(F.col("hash").isNotNull())
            .groupBy("hash").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def copy_links(df: DataFrame, value: Column, id_col: str = "id", score: Column | None = None) -> DataFrame:
    """Link every copy of a value to the lowest id that has it: pairs(id_a, id_b, score).

    A value shared by m rows gives m - 1 links, not m * (m - 1) / 2 pairs, and the
    same connected group.
    """
    keyed = df.select(F.col(id_col).alias("id_b"), value.alias("_value")).filter(F.col("_value").isNotNull())
    first = keyed.groupBy("_value").agg(F.min("id_b").alias("id_a"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # `first` has one row per value: a hot value skews one side only, which
    # adaptive execution splits.
    return (keyed.join(first.drop("_n"), "_value").filter(F.col("id_b") != F.col("id_a"))
            .select("id_a", "id_b", (F.lit(1.0) if score is None else score).alias("score")))


def copy_groups(df: DataFrame, value: Column, id_col: str = "id") -> DataFrame:
    """groups(id, group_id) of all ids that share a value with another; group_id is the lowest.

    `df` is read once: the ids and values are written down and then counted and joined.
    """
    keyed = cut(df.select(F.col(id_col).alias("id"), value.alias("_value")).filter(F.col("_value").isNotNull()), "values")
    first = keyed.groupBy("_value").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return keyed.join(first, "_value").select("id", "group_id")


def first_of_value(df: DataFrame, value: Column, id_col: str = "id") -> DataFrame:
    """(value, id): each distinct value with the lowest id that has it."""
    return (df.select(value.alias("value"), F.col(id_col).alias("id")).filter(F.col("value").isNotNull())
            .groupBy("value").agg(F.min("id").alias("id")))


def removals(df: DataFrame, groups: DataFrame, order_by: Sequence[Column], id_col: str = "id") -> DataFrame:
    """Ids to drop: every member of a group but its best.

    `order_by` sorts best first; the id settles ties. The winner is found by a
    partial aggregation, so a group of any size never meets in one task.
    """
    require(df, id_col)
    require(groups, "id", "group_id")
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order_by)], F.col(id_col).alias("id"))
    ranked = cut(df.select(F.col(id_col).alias("id"), order.alias("_order"))
                 .join(groups.select("id", "group_id"), "id"), "ranked")
    best = ranked.groupBy("group_id").agg(F.min("_order")["id"].alias("kept_id"))
    return (ranked.join(best, "group_id").filter(F.col("id") != F.col("kept_id"))
            .select("id", "group_id", "kept_id"))


def keep_best(df: DataFrame, groups: DataFrame, order_by: Sequence[Column] = (), id_col: str = "id") -> DataFrame:
    """`df` without the removals. Rows in no group stay.

    Give `order_by` as ascending keys, best first (negate a number to prefer large
    ones); nulls sort first, so replace them when they should lose.
    """
    gone = removals(df, groups, order_by, id_col).select(F.col("id").alias(id_col))
    # Few enough ids go to every task, and the wide rows are then not shuffled at all.
    return df.join(broadcast_if_small(gone), id_col, "left_anti")


def groups_from_links(links: DataFrame) -> DataFrame:
    """groups(id, group_id) from links that already point at each group's lowest id."""
    roots = links.select(F.col("id_a").alias("id"), F.col("id_a").alias("group_id")).distinct()
    return roots.unionByName(links.select(F.col("id_b").alias("id"), F.col("id_a").alias("group_id")))
