"""All pairs of hashes within a Hamming distance, exact at any skew."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.operators.exact import copy_links, first_of_value
from lumisift.schemas import require
from lumisift.session import cut

# Most choices of blocks, hence rows per hash, that any cut may need.
MOST_CHOICES = 220
# Largest bucket joined with itself as it is; larger ones are refined.
BUCKET_ROWS = 2_000


def hamming_pairs(df: DataFrame, max_distance: int, bits: int = 64, hash_col: str = "hash", id_col: str = "id",
                  bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """pairs(id_a, id_b, distance): distinct hashes at most `max_distance` bits apart.

    Each hash is represented by the lowest id that has it; further copies are linked
    to that id at distance 0. So equal hashes, however many, give one link each.

    The bits are cut into more blocks than bits may differ: a pair then agrees on
    all but `max_distance` of the blocks, for at least one choice of blocks. Each
    choice is one equi-join key, and the number of blocks grows with the number of
    hashes so that keys stay selective. Where a key still holds too many hashes,
    its members are keyed again by a finer cut of the same bits, which keeps the
    result exact: a pair in the bucket also agrees on some choice of finer blocks.
    Distinct hashes that agree on all but f bits number at most 2**f, so a refined
    bucket has a bound that does not depend on the data (2**15 for distance 3 of 60).

    Choices of blocks are weak keys beyond about 6 bits: see `multi_index.hamming_pairs_far`.
    """
    require(df, hash_col, id_col)
    if not 0 <= max_distance < bits:
        raise ValueError("max_distance must lie between 0 and the number of bits")
    # Hashes are dear to compute and 16 bytes a row to keep: written once, then
    # read by the count, the copies and the joins.
    hashes = cut(df.select(F.col(id_col).alias("id"), F.col(hash_col).cast("bigint").alias("h"))
                 .filter(F.col("h").isNotNull()))
    copies = (copy_links(hashes, F.col("h"), score=F.lit(0))
              .select("id_a", "id_b", F.col("score").cast("int").alias("distance")))
    if max_distance == 0:
        return copies
    distinct = first_of_value(hashes, F.col("h")).withColumnRenamed("value", "h")
    coarse = choose_blocks(hashes.count(), max_distance, bits)
    return _close_pairs(distinct, max_distance, bits, coarse, bucket_rows).unionByName(copies)


def choose_blocks(rows: int, max_distance: int, bits: int, per_bucket: int = 16) -> int:
    """Fewest blocks whose keys are long enough to hold `per_bucket` evenly spread hashes."""
    blocks = max_distance + 1
    while (rows >> int(bits * (blocks - max_distance) / blocks)) > per_bucket and blocks < bits \
            and comb(blocks + 1, max_distance) <= MOST_CHOICES:
        blocks += 1
    return blocks


def finer_blocks(coarse: int, max_distance: int, bits: int) -> int:
    """The finest cut that stays within the allowed number of choices."""
    blocks = min(coarse + 1, bits)
    while blocks < bits and comb(blocks + 1, max_distance) <= MOST_CHOICES:
        blocks += 1
    return blocks


def block_parts(bits: int, blocks: int) -> list[int]:
    """Bit mask of every block, as signed bigints."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _close_pairs(distinct: DataFrame, k: int, bits: int, blocks: int, bucket_rows: int) -> DataFrame:
    coarse = block_parts(bits, blocks)
    keyed = _keyed(distinct, coarse, k, [])
    # Keys held by one hash, nearly all of them, leave before the self-join.
    counts = keyed.groupBy("k0", "v0").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # Spark takes exploded rows to be as small as the table they come from, and would
    # broadcast them: joins of keys are merge joins.
    sized = keyed.join(counts.hint("merge"), ["k0", "v0"])
    largest = counts.agg(F.max("_n")).first()[0] or 0
    if largest <= bucket_rows:
        return _join(sized, [("k0", "v0", coarse)], k)
    pairs = _join(sized.filter(F.col("_n") <= bucket_rows), [("k0", "v0", coarse)], k)
    fine = block_parts(bits, finer_blocks(blocks, k, bits))
    hot = _keyed(sized.filter(F.col("_n") > bucket_rows), fine, k, ["k0", "v0"])
    return pairs.unionByName(_join(hot, [("k0", "v0", coarse), ("k1", "v1", fine)], k))


def _keyed(df: DataFrame, parts: list[int], k: int, keep: list[str]) -> DataFrame:
    """One row per choice of len(parts) - k blocks: the chosen blocks and the hash bits in them."""
    level = len(keep) // 2
    options = []
    for choice in combinations(range(len(parts)), len(parts) - k):
        mask, chosen = sum(parts[i] for i in choice), sum(1 << i for i in choice)
        options.append(f"struct({chosen}L AS k, h & {mask}L AS v)")
    return (df.select("h", "id", *keep, F.expr(f"explode(array({', '.join(options)})) AS _o"))
            .select("h", "id", *keep, F.col("_o.k").alias(f"k{level}"), F.col("_o.v").alias(f"v{level}")))


def _join(keyed: DataFrame, levels: list[tuple[str, str, list[int]]], k: int) -> DataFrame:
    keys = [c for level in levels for c in level[:2]]
    a = keyed.select(*keys, F.col("h").alias("ha"), F.col("id").alias("ia"))
    b = keyed.select(*keys, F.col("h").alias("hb"), F.col("id").alias("ib"))
    # A pair may agree on several choices: it is taken from one of them only, which
    # needs no distinct over the pairs. The cheap distance test comes first.
    once = " AND ".join(f"{number} = {_canonical_choice('(ha ^ hb)', parts, k)}" for number, _, parts in levels)
    return (a.join(b.hint("merge"), keys).filter(F.expr(f"ia < ib AND if(bit_count(ha ^ hb) <= {k}, {once}, false)"))
            .select(F.col("ia").alias("id_a"), F.col("ib").alias("id_b"), F.expr("bit_count(ha ^ hb)").alias("distance")))


def _canonical_choice(diff: str, parts: list[int], k: int) -> str:
    """SQL for the highest len(parts) - k blocks without a differing bit, as a bit set."""
    agreeing = " | ".join(f"if({diff} & {part}L = 0, {1 << i}L, 0L)" for i, part in enumerate(parts))
    return (f"aggregate(sequence(1, {k}), {agreeing}, "
            f"(g, i) -> if(bit_count(g) > {len(parts) - k}, g & (g - 1), g))")
