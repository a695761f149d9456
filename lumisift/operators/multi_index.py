"""All pairs of hashes within a large Hamming distance: multi-index hashing (Norouzi, Punjani, Fleet 2012), or blocks that all meet."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.operators.exact import copy_links, first_of_value
from lumisift.plans.skew import broadcast_if_small
from lumisift.schemas import require
from lumisift.session import cut

# Most rows that one hash may send to be looked up, at any level.
MOST_ROWS = 5_000
# A row sent costs about as much as so many comparisons inside a join.
ROW_COST = 50
# Hashes that share a substring beyond which they are cut again.
BUCKET_ROWS = 2_000
DEPTH = 3
# Comparisons of a block with a block that take as long as one inside a join.
BLOCK_SPEED = 4
# Hashes of a block: some megabytes for the two that meet in a task. Few hashes are dealt to as many blocks as keep all cores busy.
BLOCK_ROWS, SMALL_BLOCK, MANY_BLOCKS = 65_536, 2_048, 24
# Pairs compared at a time, and pairs of a batch that a task returns.
AT_ONCE, PAIRS_SENT = 1 << 17, 1 << 16


def hamming_pairs_far(df: DataFrame, max_distance: int, bits: int = 64, hash_col: str = "hash", id_col: str = "id",
                      bucket_rows: int = BUCKET_ROWS, substrings: int | None = None) -> DataFrame:
    """pairs(id_a, id_b, distance): distinct hashes at most `max_distance` bits apart, for distances up to a third of the bits.

    Each hash is represented by the lowest id that has it; further copies are linked to
    that id at distance 0. Null hashes pair with nothing.

    The bits are cut into substrings. Two hashes k bits apart differ by few bits in some
    substring (`radii`), so every hash is listed under each of its substrings as they are
    and looks up each of them with all choices of so few bits flipped: `rows_sent` rows a
    hash, at most MOST_ROWS, whatever the data. A pair is taken from the first substring
    in which it is near enough, which needs no distinct over the pairs.

    Hashes that share a substring with more than `bucket_rows` others are keyed by a second
    one as well, of bits dealt out another way, and by a third: a near pair agrees nearly
    in some substring of any cut. Distinct hashes left under one key are then bounded by
    the bits that no key holds.

    Where hashes lie so close that such buckets hold a good part of all pairs, looking up
    compares no less than all of them, and sends far more. The work is measured, and if that of
    all pairs is less, they meet in blocks: 16 bytes a hash and block, and no row for a look-up.
    """
    require(df, hash_col, id_col)
    if not 0 <= max_distance < bits <= 64:
        raise ValueError("max_distance must lie between 0 and the number of bits, 64 at most")
    hashes = cut(df.select(F.col(id_col).alias("id"), F.col(hash_col).cast("bigint").alias("h")).filter("h IS NOT NULL"), "hashes")
    copies = (copy_links(hashes, F.col("h"), score=F.lit(0))
              .select("id_a", "id_b", F.col("score").cast("int").alias("distance")))
    if max_distance == 0:
        return copies
    distinct = cut(first_of_value(hashes, F.col("h")).withColumnRenamed("value", "h"), "distinct")
    if substrings is None and blocks_are_cheaper(distinct, bits, max_distance):
        found = block_pairs(distinct, max_distance)
    else:
        found = look_up(distinct, distinct, bits, max_distance, [], ["ia < ib"], bucket_rows, substrings)
    return found.unionByName(copies)


def blocks_are_cheaper(distinct: DataFrame, bits: int, distance: int) -> bool:
    """Whether comparing all of distinct(h, id) is less work than looking up, by the rows that each substring really has."""
    rows = distinct.count()
    parts = choose_parts(rows, bits, distance)
    cuts, within = cut_bits(bits, parts), radii(distance, parts)
    sizes = listed_rows(distinct, cuts, within).groupBy("c0", "v0").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    squares = dict(sizes.groupBy("c0").agg(F.sum(F.col("_n") * F.col("_n"))).collect())
    # Hashes under one substring, times those under another, are at most half of both squares.
    compared = sum(_flips(len(cuts[c]), within[c]) * n for c, n in squares.items())
    return rows * rows / 2 <= BLOCK_SPEED * (compared + ROW_COST * rows_sent(bits, distance, parts) * rows)


def block_pairs(distinct: DataFrame, distance: int) -> DataFrame:
    """Pairs of distinct(h, id) within the distance: every block of hashes meets every block, each two in one task."""
    rows = distinct.filter("id IS NOT NULL").select("id", "h")
    n = rows.count()
    blocks = max(ceil(n / BLOCK_ROWS), min(MANY_BLOCKS, ceil(n / SMALL_BLOCK)), 1)
    own, other = F.pmod(F.xxhash64("h"), F.lit(blocks)), F.col("_o")
    cells = (rows.withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .select(F.least("_b", other).alias("i"), F.greatest("_b", other).alias("j"), (F.col("_b") > other).alias("second"), "id", "h")
             .repartition(blocks * (blocks + 1) // 2, "i", "j").sortWithinPartitions("i", "j", "id"))
    kind = distinct.schema["id"].dataType.simpleString()
    found = cells.mapInArrow(_compared(distance), f"ia {kind}, ib {kind}, distance int")
    # The same id may have two hashes.
    return found.filter("ia <> ib").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), "distance")


def _compared(distance: int):
    """Arrow batches of (i, j, second, id, h), sorted by cell (i, j) and id -> (ia, ib, distance)."""
    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = rows.column("id").combine_chunks()
        h = rows.column("h").to_numpy().view(np.uint64)
        if rows.column("i")[0] == rows.column("j")[0]:
            first = second = np.arange(len(h))
        else:
            side = rows.column("second").to_numpy()
            first, second = np.flatnonzero(~side), np.flatnonzero(side)
        if not len(first) or not len(second):
            return
        step, others = max(1, AT_ONCE // len(second)), h[second]
        found, held = [], 0
        for at in range(0, len(first), step):
            a = first[at:at + step]
            bits = np.bitwise_count(h[a][:, None] ^ others[None, :]).ravel()
            near = np.flatnonzero(bits <= distance)
            x, y = np.divmod(near, len(second))
            if first is second:
                once = y > x + at
                near, x, y = near[once], x[once], y[once]
            found.append((a[x], second[y], bits[near].astype(np.int32)))
            held += len(near)
            if held >= PAIRS_SENT or at + step >= len(first):
                x, y, far = (np.concatenate(part) for part in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(far)], ["ia", "ib", "distance"])
                found, held = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = pc.add(pc.multiply(batch.column("i"), 1 << 32), batch.column("j")).to_numpy()
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]
            for start, end in zip(edges, edges[1:]):
                piece = batch.slice(start, end - start)
                if waiting and (waiting[0].column("i")[0], waiting[0].column("j")[0]) != (piece.column("i")[0], piece.column("j")[0]):
                    yield from pairs(pa.Table.from_batches(waiting))
                    waiting = []
                waiting.append(piece)
        if waiting:
            yield from pairs(pa.Table.from_batches(waiting))
    return run


def radii(distance: int, parts: int) -> list[int]:
    """Bits by which substrings may differ: hashes `distance` apart are that near in one of them at least.

    If no substring is, they differ by sum(radius + 1) = distance + 1 bits or more.
    """
    return [distance // parts if i <= distance % parts else distance // parts - 1 for i in range(parts)]


def substring_lengths(bits: int, parts: int) -> list[int]:
    edges = [round(i * bits / parts) for i in range(parts + 1)]
    return [b - a for a, b in zip(edges, edges[1:])]


def _flips(length: int, radius: int) -> int:
    return sum(comb(length, r) for r in range(radius + 1))


def rows_sent(bits: int, distance: int, parts: int) -> int:
    """Rows a hash sends: one for each substring, and its look-ups. A radius of -1 needs neither."""
    each = zip(substring_lengths(bits, parts), radii(distance, parts))
    return sum(1 + _flips(n, r) for n, r in each if r >= 0)


def choose_parts(rows: int, bits: int, distance: int) -> int:
    """Number of substrings with the least work: rows sent and, for evenly spread hashes, pairs compared."""
    def work(parts: int) -> float:
        each = zip(substring_lengths(bits, parts), radii(distance, parts))
        return ROW_COST * rows_sent(bits, distance, parts) + sum(rows * _flips(n, r) / 2 ** n for n, r in each if r >= 0)
    allowed = [p for p in range(1, min(bits, distance + 1) + 1) if rows_sent(bits, distance, p) <= MOST_ROWS]
    return min(allowed or [min(bits, distance + 1)], key=work)


def cut_bits(bits: int, parts: int, level: int = 0) -> list[list[int]]:
    """Places of bits in so many substrings of about equal length; each level deals them out another way."""
    order = [list(range(bits)), sorted(range(bits), key=lambda p: (p % parts, p)), sorted(range(bits), key=lambda p: (p * 29 % 67, p))][level]
    out, at = [], 0
    for n in substring_lengths(bits, parts):
        out.append(order[at:at + n])
        at += n
    return out


def _mask(places: Sequence[int]) -> int:
    mask = sum(1 << p for p in places)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def listed_rows(df: DataFrame, cuts: list[list[int]], within: list[int], level: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """(h, id, keys, c<level>, v<level>): every hash under each of its substrings."""
    rows = ", ".join(f"struct({i} AS c, h & {_mask(cuts[i])}L AS v)" for i in range(len(cuts)) if within[i] >= 0)
    return (df.select("h", "id", *keys, F.expr(f"explode(array({rows})) AS _o"))
            .select("h", "id", *keys, F.col("_o.c").alias(f"c{level}"), F.col("_o.v").alias(f"v{level}")))


def asked_rows(df: DataFrame, cuts: list[list[int]], within: list[int], level: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """(h, id, keys, c<level>, v<level>): each substring with up to `within` of its bits flipped."""
    rows = ", ".join(f"struct({i} AS c, {_mask(places)}L AS p, {_mask(choice)}L AS m)"
                     for i, places in enumerate(cuts) for r in range(within[i] + 1) for choice in combinations(places, r))
    return (df.select("h", "id", *keys, F.expr(f"explode(array({rows})) AS _f"))
            .select("h", "id", *keys, F.col("_f.c").alias(f"c{level}"), F.expr("(h & _f.p) ^ _f.m").alias(f"v{level}")))


def first_near(cuts: list[list[int]], within: list[int], part: str) -> str:
    """SQL: `part` is the first substring in which ha and hb are near enough."""
    near = " ".join(f"WHEN bit_count((ha ^ hb) & {_mask(cuts[i])}L) <= {within[i]} THEN {i}" for i in range(len(cuts)) if within[i] >= 0)
    return f"(CASE {near} END) = {part}"


def look_up(listed: DataFrame, asking: DataFrame, bits: int, distance: int, keys: Sequence[str], conditions: Sequence[str], bucket_rows: int,
            parts: int | None = None) -> DataFrame:
    """Pairs of listed(h, id, keys...) and asking(h, id, keys...) with equal keys that are near enough and meet all conditions.

    `keys` are those of the levels above, two each; `conditions` are SQL on ha, hb, ia,
    ib and keys, and say, among others, that a pair belongs to those keys.
    """
    level = len(keys) // 2
    parts = parts or choose_parts(listed.count(), bits, distance)
    cuts, within = cut_bits(bits, parts, level), radii(distance, parts)
    here = [*keys, f"c{level}", f"v{level}"]
    conditions = [*conditions, first_near(cuts, within, f"c{level}")]
    entries, probes = listed_rows(listed, cuts, within, level, keys), asked_rows(asking, cuts, within, level, keys)
    if level + 1 < DEPTH and parts > 1:
        crowded = cut(entries.groupBy(*here).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bucket_rows).drop("_n"), "crowded")
        if not crowded.isEmpty():
            hot = broadcast_if_small(crowded)
            left, right = (cut(t.join(hot, here, "left_semi"), "crowd") for t in (entries, probes))
            entries, probes = (t.join(hot, here, "left_anti") for t in (entries, probes))
            return (joined(entries, probes, here, conditions, distance)
                    .unionByName(look_up(left, right, bits, distance, here, conditions, bucket_rows)))
    return joined(entries, probes, here, conditions, distance)


def joined(entries: DataFrame, probes: DataFrame, keys: list[str], conditions: list[str], distance: int) -> DataFrame:
    """Listed and asking hashes with equal keys that are within the distance and meet all conditions on ha, hb, ia, ib."""
    a = entries.withColumnsRenamed({"h": "ha", "id": "ia"})
    b = probes.withColumnsRenamed({"h": "hb", "id": "ib"})
    near = f"if(bit_count(ha ^ hb) <= {distance}, {' AND '.join(conditions)}, false)"
    # Spark takes exploded rows to be as small as the table they come from, and would broadcast them.
    return (a.join(b.hint("merge"), keys).filter(F.expr(near))
            .select(F.col("ia").alias("id_a"), F.col("ib").alias("id_b"), F.expr("bit_count(ha ^ hb)").alias("distance")))
