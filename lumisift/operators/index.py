"""The image index: refresh, browse, pair with captions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.functions.tags import folder, stem
from lumisift.schemas import require


def diff_index(prior: DataFrame, scan: DataFrame, key: str = "path",
               compare: Sequence[str] = ("length", "mtime")) -> DataFrame:
    """Every key of either side with its `change`: new, changed, deleted or same.

    Keys are unique on both sides, so the full outer join cannot skew. Columns are
    the scan's; a deleted row shows its last known values.
    """
    require(prior, key, *compare)
    require(scan, key, *compare)
    old = prior.select(key, *[F.col(c).alias(f"_old_{c}") for c in scan.columns if c != key and c in prior.columns],
                       F.lit(True).alias("_in_old"))
    both = scan.withColumn("_in_new", F.lit(True)).join(old, key, "full_outer")
    same = F.lit(True)
    for c in compare:
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    change = (F.when(F.col("_in_old").isNull(), "new")
              .when(F.col("_in_new").isNull(), "deleted")
              .when(same, "same").otherwise("changed"))
    values = [F.col(c) if c == key or f"_old_{c}" not in both.columns
              else F.when(F.col("_in_new").isNull(), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c)
              for c in scan.columns]
    return both.select(*values, change.alias("change"))


def next_snapshot(changes: DataFrame) -> DataFrame:
    """The refreshed index: everything that still exists."""
    return changes.filter(F.col("change") != "deleted").drop("change")


def browse(index: DataFrame, where: Column | None = None, order_by: Sequence[str] = (),
           after: Sequence | None = None, limit: int = 50, key: str = "path") -> DataFrame:
    """One page of an index, ordered by `order_by` (`-name` for descending) and then `key`.

    `after` holds the sort values of the last row seen, `key` last. It becomes a
    predicate, so page 1,000 costs what page 1 costs.
    """
    require(index, key)
    columns = [c for c in order_by if c.lstrip("-") != key] + [key]
    page = index if where is None else index.filter(where)
    if after is not None:
        if len(after) != len(columns):
            raise ValueError(f"after needs one value per sort column {columns}")
        # (a, b) after (x, y)  <=>  a > x or (a = x and b > y)
        beyond = F.lit(False)
        for c, value in reversed(list(zip(columns, after))):
            col, at = F.col(c.lstrip("-")), F.lit(value)
            step = _passes(col, value, c.startswith("-"))
            beyond = step | (col.eqNullSafe(at) & beyond)
        page = page.filter(beyond)
    order = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in columns]
    return page.orderBy(*order).limit(limit)


def _passes(col: Column, value, descending: bool) -> Column:
    """Strictly later than `value` when nulls sort last."""
    if value is None:
        return F.lit(False)
    return col.isNull() | ((col < F.lit(value)) if descending else (col > F.lit(value)))


def attach_captions(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Add the `caption` of the text file with the same folder and stem; null without one."""
    require(images, "path")
    require(texts, "path", "caption")
    keyed = texts.select(folder(F.col("path")).alias("_folder"), stem(F.col("path")).alias("_stem"), "caption")
    return (images.withColumn("_folder", folder(F.col("path"))).withColumn("_stem", stem(F.col("path")))
            .join(keyed, ["_folder", "_stem"], "left").select(*images.columns, "caption"))


def orphan_captions(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Text files that belong to no image."""
    require(images, "path")
    require(texts, "path")
    keyed = images.select(folder(F.col("path")).alias("_folder"), stem(F.col("path")).alias("_stem"))
    return (texts.withColumn("_folder", folder(F.col("path"))).withColumn("_stem", stem(F.col("path")))
            .join(keyed, ["_folder", "_stem"], "left_anti").select(*texts.columns))
