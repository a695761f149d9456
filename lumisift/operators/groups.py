"""Duplicate groups: connected components of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.schemas import require
from lumisift.session import cut

# Edges that one task settles at the end: some hundred kilobytes.
LAST_EDGES = 16_000
# Edges that a task contracts at a time.
HELD_EDGES = 1_000_000


def duplicate_groups(pairs: DataFrame, max_rounds: int = 50, last_edges: int = LAST_EDGES) -> DataFrame:
    """groups(id, group_id) of every id in a pair; group_id is the lowest id of its group.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every round
    replaces edges so that each node points at a smaller one, until all edges of a
    group point at its lowest id. Before the first and after every round, each task
    contracts the edges it holds to a star per group of its own (union and find), so a
    chain gets shorter by the edges of a partition and not by half. Once no more than
    `last_edges` are left, one task does the rest. Pairs may come either way round;
    self-pairs, nulls and repeats are ignored. Each round is written to the shared folder,
    so a lost executor costs at most one round.
    """
    require(pairs, "id_a", "id_b")
    low, high = F.least("id_a", "id_b"), F.greatest("id_a", "id_b")
    pairs = pairs.filter("id_a IS NOT NULL AND id_b IS NOT NULL")
    edges = cut(_contracted(pairs.select(high.alias("u"), low.alias("v")).filter("u <> v").distinct()))
    before = _state(edges)
    for _ in range(max_rounds):
        small = before[0] <= last_edges
        # A handful of edges in one task; then they are all of their groups' and final.
        edges = cut(_contracted(edges.coalesce(1), held=last_edges + 1) if small else _contracted(_small_star(_large_star(edges))))
        now = before if small else _state(edges)
        if now == before:
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(roots)
        before = now
    raise RuntimeError(f"groups still changing after {max_rounds} rounds")


def contracted_links(pairs: DataFrame) -> DataFrame:
    """pairs(id_a, id_b) that connect the same ids: of those that a task holds, one from each id to the lowest that it reaches.

    Where only groups are wanted, pairs need not be written or shuffled one by one. Self-pairs are left out.
    """
    pairs = pairs.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v"))
    return _contracted(pairs).select(F.col("v").alias("id_a"), F.col("u").alias("id_b"))


def _contracted(edges: DataFrame, held: int | None = None) -> DataFrame:
    """Per task, edges that connect the same nodes: one from each node to the lowest that it reaches within the task."""
    held = held or HELD_EDGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            n += batch.num_rows
            if n >= held:
                yield _star(waiting, batch.schema.types[0])
                waiting, n = [], 0
        if n:
            yield _star(waiting, batch.schema.types[0])
    return edges.mapInArrow(run, edges.schema)


def _star(edges: list[tuple[np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, x, y = np.arange(len(nodes)), place[:len(a)], place[len(a):]
    while len(x):  # places rise with ids: each root joins the lowest that an edge connects it to, then edges go from root to root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    to = nodes[root]
    own = to != nodes
    return pa.RecordBatch.from_arrays([pa.array(x[own], kind) for x in (nodes, to)], ["u", "v"])


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free checksum; the decimal sum cannot overflow."""
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # One row per node after partial aggregation: a hub with very many neighbours
    # skews only the left side of the join, which adaptive execution splits.
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.filter(F.col("v") > F.col("u"))
    return larger.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(smallest, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()
