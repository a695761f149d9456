"""Tag tables: format, parse, explode, count, edit, and tags from file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.functions import tags as tg
from lumisift.plans.skew import broadcast_if_small
from lumisift.schemas import require
from lumisift.session import cut

EDIT_OPS = ("remove", "replace", "add")
MOST_LITERAL = 256  # edits that go into the expression


def format_tags(df: DataFrame, add_comma: bool = True, remove_underscore: bool = True,
                use_escape: bool = True, raw: str = "raw", out: str = "caption") -> DataFrame:
    """Add the caption text made from raw, blank-separated tags."""
    require(df, raw)
    return df.withColumn(out, tg.format_caption(F.col(raw), add_comma, remove_underscore, use_escape))


def parse_tags(df: DataFrame, caption: str = "caption", out: str = "tags", comma_separated: bool = True) -> DataFrame:
    """Add the tag array of a caption.

    Captions written without commas but with blanks for underscores no longer show
    where a tag ends, so only comma-separated captions are accepted.
    """
    require(df, caption)
    if not comma_separated:
        raise ValueError("captions without commas cannot be split back into tags")
    return df.withColumn(out, tg.parse_caption(F.col(caption)))


def explode_tags(df: DataFrame, id_col: str = "id", tags: str = "tags") -> DataFrame:
    """One row per (id, pos, tag); pos starts at 0."""
    require(df, id_col, tags)
    return df.select(F.col(id_col).alias("id"), F.posexplode(tags).alias("pos", "tag"))


def tag_counts(df: DataFrame, id_col: str = "id", tags: str = "tags") -> DataFrame:
    """Images per tag and their share of all images; `df` holds one row per image.

    Repeats inside an image are dropped before the explode, so one partial
    aggregation per task replaces a distinct count over (tag, id).
    """
    require(df, id_col, tags)
    images = df.agg(F.count(F.lit(1)).alias("_all"))
    per_tag = (df.select(F.explode(F.array_distinct(tags)).alias("tag"))
               .groupBy("tag").agg(F.count(F.lit(1)).alias("images")))
    return per_tag.select("tag", "images", (F.col("images") / images.scalar()).alias("share"))


def edit_tags(df: DataFrame, edits: DataFrame, id_col: str = "id", tags: str = "tags",
              dedupe: bool = True, sort: bool = False, most_literal: int = MOST_LITERAL) -> DataFrame:
    """Apply a table `edits(op, tag, new_tag)` of bulk edits to a tag array.

    Order: remove, replace (one pass, no chaining), add if absent, dedupe (first
    wins), sort. Two replacements of one tag by different tags raise an error. Every row
    is edited by itself, whatever its id: null and repeated ids stay as they are.

    Up to `most_literal` edits go into the expression and nothing is shuffled. Beyond
    that rows are numbered, written, and their tags joined with the edits.
    """
    require(df, id_col, tags)
    require(edits, "op", "tag", "new_tag")
    changes = (edits.filter(F.col("op").isin(*EDIT_OPS) & F.col("tag").isNotNull()).groupBy("tag")
               .agg(F.max(F.col("op") == "remove").alias("remove"), F.max(F.col("op") == "add").alias("add"),
                    F.min(F.when(F.col("op") == "replace", F.col("new_tag"))).alias("new"),
                    F.max(F.when(F.col("op") == "replace", F.col("new_tag"))).alias("new2")))
    changes = cut(changes, "edits")
    n, clash = changes.agg(F.count(F.lit(1)), F.min(F.when(F.col("new") != F.col("new2"), F.col("tag")))).first()
    if clash is not None:
        raise ValueError(f"{clash!r} has two replacements")
    present = F.filter(tags, lambda t: t.isNotNull())
    if n <= most_literal:
        rows = changes.collect()
        return df.withColumn(tags, tg.edit_tag_array(
            present, [r.tag for r in rows if r.remove], {r.tag: r.new for r in rows if r.new is not None and not r.remove},
            sorted(r.tag for r in rows if r.add), dedupe, sort))
    numbered = cut(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    rows = numbered.select("_row", F.posexplode_outer(present).alias("_pos", "tag"))
    edited = (rows.join(broadcast_if_small(changes.select("tag", "remove", "new")), "tag", "left")
              .withColumn("tag", F.when(~F.coalesce("remove", F.lit(False)), F.coalesce("new", "tag"))))
    # A tag array is bounded by one image, so collecting it per row is safe.
    packed = edited.groupBy("_row").agg(F.sort_array(F.collect_list(F.when(F.col("tag").isNotNull(), F.struct("_pos", "tag")))).alias("_packed"))
    additions = changes.filter("add").agg(F.sort_array(F.collect_list("tag")).alias("_add"))
    kept = F.transform("_packed", lambda s: s["tag"])
    out = F.concat(kept, F.array_except(additions.scalar(), kept))
    out = F.array_distinct(out) if dedupe else out
    packed = packed.select("_row", (F.sort_array(out) if sort else out).alias("_tags"))
    return numbered.join(packed, "_row").withColumn(tags, F.col("_tags")).select(*df.columns)


def filename_tags(df: DataFrame, regex: str = "", path: str = "path", out: str = "tags") -> DataFrame:
    """Add the tags found in the file name: matches of `regex`, or the whole stem."""
    require(df, path)
    return df.withColumn(out, tg.words_of_stem(F.col(path), regex))
