"""Merkle manifest of a dataset: hash trees whose aligned subtrees lie in van Emde Boas order.

A tree has a fan-out of 16. It is cut into aligned subtrees of 16**HEIGHT leaves, the
blocks; the roots of the blocks of one round are the leaves of the next. A block keeps
its nodes in one byte string: the upper half of its levels first, then each subtree
below them, every part laid out in the same way. So a path from a leaf to the root of
its block meets few cache lines or pages of any size, and a node's place is arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumisift.llm.common import Scratch, by_row

FAN = 16
HEIGHT = 3  # levels of nodes above the leaves of a block: 4,096 leaves
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---- the layout -------------------------------------------------------------------

def tree_size(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (FAN ** levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Place of the nodes `index` of level `depth` (0 is the root) in a tree of `levels` levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    below, width = levels - top, FAN ** (depth - top)
    return tree_size(top) + index // width * tree_size(below) + address(below, depth - top, index % width)


@lru_cache(maxsize=64)
def _places(levels: int, depth: int) -> np.ndarray:
    return address(levels, depth, np.arange(FAN ** depth))


def _digest(children: list[bytes]) -> bytes:
    """Hash of digests as hex text."""
    return sha256(b"".join(children).hex().encode()).digest()


def lay_out(leaves: list[bytes], height: int) -> bytes:
    """The nodes of one block: `height` levels above up to 16**height leaves."""
    levels = [leaves]
    for _ in range(height):
        below = levels[-1]
        levels.append([_digest(below[i:i + FAN]) for i in range(0, len(below), FAN)])
    used = [_places(height + 1, height - up)[:len(nodes)] for up, nodes in enumerate(levels)]
    out = np.zeros((max(int(p.max()) for p in used) + 1, 32), np.uint8)
    for places, nodes in zip(used, levels, strict=True):
        out[places] = np.frombuffer(b"".join(nodes), np.uint8).reshape(-1, 32)
    return out.tobytes()


def runs(nodes: bytes, height: int, n: int) -> list[list[str]]:
    """Hex text of every run of siblings of a block, level by level from the leaves."""
    out, levels = [], height + 1
    for up in range(height):
        at = _places(levels, height - up)[:n].tolist()
        text = [nodes[32 * p:32 * p + 32].hex() for p in at]
        out.append(["".join(text[i:i + FAN]) for i in range(0, n, FAN)])
        n = len(out[-1])
    return out


def path(levels: list[list[str]], leaf: int) -> list[tuple[int, str]]:
    """(own place, the others' digests as hex text) of the runs from a leaf to the root of its block."""
    out = []
    for level in levels:
        leaf, own = divmod(leaf, FAN)
        run = level[leaf]
        out.append((own, run[:64 * own] + run[64 * own + 64:]))
    return out


def fold(leaf: str, steps: list[tuple[int, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for own, others in steps:
        leaf = sha256((others[:64 * own] + leaf + others[64 * own:]).encode()).hexdigest()
    return leaf


# ---- digests of rows --------------------------------------------------------------

def row_digest(*values: Column) -> Column:
    """sha-256, in hex, of the values as text: `-` for null, else length in bytes, a colon and the value."""
    def shown(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*map(shown, values)), 256)


# ---- building ---------------------------------------------------------------------

@dataclass
class Forest:
    """Blocks of some trees, by round: blocks[r](tree, block, n, height, nodes, root), and roots(tree, root)."""
    blocks: list[DataFrame]
    roots: DataFrame


def _needed(n: Column, done: int, height: int) -> Column:
    """Levels of a block in a tree of n leaves whose lowest `done` levels are built: up to `height`, as many as the tree has."""
    tall = sum((F.when(n > F.lit(FAN ** (done + h)), 1).otherwise(0) for h in range(height)), F.lit(0))
    return tall.cast("int")


def _build(t: pa.Table) -> pa.Table:
    order = np.argsort(t["pos"].to_numpy())
    leaves = t["digest"].to_pylist()
    leaves, height = [leaves[i] for i in order], t["height"][0].as_py()
    nodes = lay_out(leaves, height)
    return pa.table({"tree": t["tree"][:1], "block": t["block"][:1], "size": t["size"][:1], "n": pa.array([len(leaves)], pa.int32()),
                     "height": t["height"][:1], "nodes": pa.array([nodes], pa.binary()), "root": pa.array([nodes[:32]], pa.binary())})


def build_forest(scratch: Scratch, leaves: DataFrame, height: int = HEIGHT) -> Forest:
    """Trees over leaves(tree, pos, size, digest): pos counts from 0 in a tree of `size` leaves.

    A round builds all blocks of its level, each in one task, and hands their roots to
    the next; the driver counts rounds, which are the logarithm of the largest tree.
    """
    blocks, done, roots = [], 0, None
    level = leaves
    while True:
        keyed = level.withColumns({"block": F.floor(F.col("pos") / F.lit(FAN ** height)).cast("long"), "height": _needed(F.col("size"), done, height)})
        built = scratch.cut(keyed.groupBy("tree", "block").applyInArrow(_build, "tree bigint, block bigint, size bigint, n int, height int, nodes binary, root binary"), "blocks")
        blocks.append(built)
        done += height
        closed = F.col("size") <= F.lit(FAN ** done)
        ready = built.filter(closed).select("tree", "root")
        roots = ready if roots is None else roots.unionByName(ready)
        level = built.filter(~closed).select("tree", F.col("block").alias("pos"), "size", F.col("root").alias("digest"))
        if level.isEmpty():
            return Forest(blocks, roots)


# ---- proofs -----------------------------------------------------------------------

_STEPS = "array<struct<own: int, others: string>>"
_STEPS_ARROW = pa.list_(pa.struct([("own", pa.int32()), ("others", pa.string())]))


def _handed_down(height: int):
    """Each leaf of a round's blocks, which is a block of the round before, with its path to the last root."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for b in batch.to_pylist():
            levels, above = runs(b["nodes"], b["height"], b["n"]), b["above"] or []
            for leaf in range(b["n"]):
                steps = [{"own": own, "others": others} for own, others in path(levels, leaf)]
                out.append((b["tree"], b["block"] * FAN ** height + leaf, steps + above))
        tree, block, above = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(tree, pa.int64()), pa.array(block, pa.int64()), pa.array(above, _STEPS_ARROW)], ["tree", "block", "above"])
    return fn


def with_paths(scratch: Scratch, forest: Forest, tops: DataFrame | None = None, height: int = HEIGHT) -> DataFrame:
    """The lowest blocks with `above`: the steps from a block's root to the last root.

    `tops` is (tree, above): the steps that follow a tree's own root, if there are any.
    Paths are handed down from the few blocks of the last round to the many of the
    first; no row holds more than a block and a path.
    """
    handed = None
    for r in reversed(range(len(forest.blocks))):
        here = forest.blocks[r]
        last = F.col("size") <= F.lit(FAN ** (height * (r + 1)))
        ends = here.filter(last)
        ends = ends.withColumn("above", F.lit(None).cast(_STEPS)) if tops is None else ends.join(tops, "tree", "left")
        if handed is not None:
            ends = ends.unionByName(here.filter(~last).join(handed, ["tree", "block"]))
        if r:
            handed = scratch.cut(by_row(ends, _handed_down(height), f"tree bigint, block bigint, above {_STEPS}"), "paths")
    return ends


# ---- the manifest of a dataset ----------------------------------------------------

@dataclass
class Manifest:
    """rows(id, tree, pos, size, digest, ...): the leaves; one tree per source; `top` over their roots in order."""
    rows: DataFrame
    trees: DataFrame
    forest: Forest
    top: Forest
    height: int

    def root(self) -> str | None:
        """The dataset's digest; None without rows."""
        row = self.top.roots.first()
        return None if row is None else bytes(row["root"]).hex()


def ranked(scratch: Scratch, rows: DataFrame, *order: Column) -> DataFrame:
    """Add `rank`, the place of each row from 0 by `order`, which must tell all rows apart.

    A range sort and the sizes of its partitions; no task sees more than a partition.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.cut(placed, "sorted")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the sort.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return (placed.withColumn("_part", part).join(starts, "_part")
            .withColumn("rank", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_start"))


def manifest(scratch: Scratch, leaves: DataFrame, height: int = HEIGHT) -> Manifest:
    """Manifest of leaves(id, source, digest, ...); digests are bytes.

    Per source (null first, then by code point) a tree over its leaves by id, null first.
    Rows that repeat an id stand side by side, by digest.
    """
    leaves = scratch.cut(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    order = [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest").asc(), F.col("_row").asc()]
    placed = scratch.cut(ranked(scratch, leaves, *order).drop("_row"), "ranked")
    sources = scratch.cut(placed.groupBy("source").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("size")), "sources")
    # Sources in order are trees 0, 1, ...: the place of a source among the first ranks.
    trees = scratch.cut(ranked(scratch, sources, F.col("first").asc()).withColumnRenamed("rank", "tree"), "trees")
    rows = (placed.join(trees.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("pos", F.col("rank") - F.col("first")).drop("_source", "rank", "first"))
    rows = scratch.cut(rows, "placed")
    forest = build_forest(scratch, rows.select("tree", "pos", "size", "digest"), height)
    heads = forest.roots.withColumnsRenamed({"tree": "pos", "root": "digest"})
    top = build_forest(scratch, heads.select(F.lit(0).cast("long").alias("tree"), "pos", F.lit(trees.count()).cast("long").alias("size"), "digest"), height)
    return Manifest(rows, trees, forest, top, height)


def _audited(root: str, height: int):
    """Rows of a block and the block with its path -> proofs and folded roots of the rows."""
    def fn(rows: pa.Table, block: pa.Table) -> pa.Table:
        if not rows.num_rows or not block.num_rows:  # each block has rows
            raise ValueError("a leaf without a block, or a block without leaves")
        b = block.to_pylist()[0]
        levels, above = runs(b["nodes"], b["height"], b["n"]), [(s["own"], s["others"]) for s in b["above"] or []]
        tail = "".join(others for _, others in above)
        subroot = bytes(b["subroot"]).hex()
        out = []
        for doc, pos, digest, seen in zip(*(rows[c].to_pylist() for c in ("id", "pos", "digest", "seen")), strict=True):
            steps = path(levels, pos % FAN ** height)
            proof = sha256(("".join(others for _, others in steps) + tail).encode()).hexdigest()
            folded = fold(seen.hex(), steps + above)
            out.append((doc, digest.hex(), subroot, root, proof, folded, folded == root))
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.Table.from_arrays(cols, ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return fn


def audit(made: Manifest, scratch: Scratch) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of a manifest.

    Column `seen` of its rows is the digest of the row as it is now; its fold through the
    stored siblings equals the root if and only if nothing has changed.
    """
    root = made.root()
    if root is None:
        schema = "id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return scratch.spark.createDataFrame([], schema)
    over = by_row(with_paths(scratch, made.top, height=made.height), _handed_down(made.height), f"tree bigint, block bigint, above {_STEPS}")
    tops = scratch.cut(over.select(F.col("block").alias("tree"), "above"), "tops")
    blocks = with_paths(scratch, made.forest, tops, made.height).join(made.forest.roots.withColumnRenamed("root", "subroot"), "tree")
    blocks = scratch.cut(blocks.select("tree", "block", "n", "height", "nodes", "above", "subroot"), "paths")
    rows = made.rows.withColumn("block", F.floor(F.col("pos") / F.lit(FAN ** made.height)).cast("long"))
    return (rows.select("tree", "block", "id", "pos", "digest", "seen").groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block"))
            .applyInArrow(_audited(root, made.height), "id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"))


def tampering_report(docs: DataFrame, id_col: str = "doc_id", every: int = 5, height: int = HEIGHT) -> DataFrame:
    """(id_col, leaf, subroot, root, proof_sha256, folded_root, verified) for every document.

    A leaf is the digest of doc_id, source, lang, n_chars and text. The manifest is built
    over the documents as they are; then the texts of those whose crc32 of the id (as
    decimal text) `every` divides have A-Z lower-cased, and every row's digest is folded
    through its siblings to see whether it still leads to the root.

    Null values have a digest of their own (`-`). A null id comes first in its source and
    is not tampered with; a tampered text without A-Z, or null, still leads to the root.
    Rows that repeat an id are leaves each, in the order of their digests. An empty table
    has no root and gives no rows. A long text is read once for each of its two digests.
    """
    scratch = Scratch(docs.sparkSession)
    values = [F.col(c) for c in (id_col, "source", "lang", "n_chars")]
    text = F.col("text")
    tampered = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0, F.lit(False))
    leaf = row_digest(*values, text)
    seen = F.when(tampered, row_digest(*values, F.translate(text, _UPPER, _LOWER))).otherwise(leaf)
    leaves = docs.select(F.col(id_col).cast("long").alias("id"), F.col("source").cast("string").alias("source"),
                         F.unhex(leaf).alias("digest"), F.unhex(seen).alias("seen"))
    return audit(manifest(scratch, leaves, height), scratch).withColumnRenamed("id", id_col)
