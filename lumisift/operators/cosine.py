"""All pairs of feature vectors with a cosine of at least a threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.functions.vectors import matrix, unit
from lumisift.operators.exact import copy_links
from lumisift.plans.skew import broadcast_if_small
from lumisift.schemas import require
from lumisift.session import cut

MAX_PIVOTS = 256  # bounds what the driver holds: pivots, cell statistics, cell pairs
MISSED = 0.01  # chance that `lsh` misses a pair whose cosine is the threshold; likelier pairs are missed less
SENT = 300  # products of two vectors that take as long as sending one vector to a task
SHARES = 32  # shares of all rows that meet two by two: a row is sent to about so many of them
MOST_HELD = 32_768  # rows of such a share, at most
HELD_BYTES = 32 << 20  # bytes of such a share, at most
MOST_SENT = 2 * SHARES  # times that `lsh` sends a row, where some number of signs allows it
PAIRS = "id_a bigint, id_b bigint, score double"


def cosine_pairs(df: DataFrame, threshold: float, features: str = "features", id_col: str = "id",
                 mode: str = "exact", all_pairs: bool = True, block_rows: int = 4096, **lsh) -> DataFrame:
    """pairs(id_a, id_b, score): distinct vectors with cosine >= threshold; score to 6 places.

    Equal vectors are represented by the lowest id and linked to it with score 1.
    Zero and null vectors pair with nothing.

    `exact` compares blocks of bounded size with one matrix product per pair of
    blocks, and skips pairs of cells that the triangle inequality on angles shows to
    be too far apart. It suits up to some 10**6 distinct vectors, or more when they
    cluster well. With `all_pairs=False` vectors similar to the pivot of their cell are
    linked to it and not compared with each other: the same groups, but a crowd of
    near copies costs a link per row. `lsh` (Charikar 2002) compares only vectors that agree on a band
    of random hyperplane signs and may miss pairs; every score it gives is exact. There are
    as many bands as a pair at the threshold needs to be found but for a chance of MISSED,
    whatever the number of vectors. What it finds does not depend on how crowded a bucket
    is: a bucket of many vectors is cut into blocks that are compared two by two.
    """
    require(df, features, id_col)
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(features).alias("v"))
    rows = cut(rows.withColumn("u", unit(F.col("v"))).filter(F.col("u").isNotNull()), "vectors")
    # Copies meet by two hashes of the vector, not by the vector itself; -0.0 counts as 0.0.
    plain = F.transform("v", lambda x: x + F.lit(0).cast("float"))
    rows = rows.withColumn("h", F.struct(F.xxhash64(plain), F.xxhash64(F.lit(1), plain)))
    copies = copy_links(rows, F.col("h"))
    first = rows.groupBy("h").agg(F.min("id").alias("id"))
    distinct = rows.join(first.select("id"), "id", "left_semi").select("id", "u")
    if mode == "exact":
        near = _grid_pairs(distinct, threshold, block_rows, all_pairs)
    elif mode == "lsh":
        near = _lsh_pairs(distinct, threshold, **lsh)
    else:
        raise ValueError("mode must be 'exact' or 'lsh'")
    return near.unionByName(copies)


def _grid_pairs(distinct: DataFrame, threshold: float, block_rows: int, all_pairs: bool) -> DataFrame:
    spark = distinct.sparkSession
    n = distinct.count()
    wanted = max(1, min(MAX_PIVOTS, n // block_rows))
    # Rows of lowest hash: a fixed sample of at most MAX_PIVOTS vectors.
    sample = distinct.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    if not sample:
        return spark.createDataFrame([], PAIRS)
    pivots, pivot_ids = np.array([r["u"] for r in sample]), np.array([r["id"] for r in sample], dtype=np.int64)

    @F.pandas_udf("home int, pivot bigint, cosine double")
    def nearest(u: pd.Series) -> pd.DataFrame:
        cos = np.round(matrix(u) @ pivots.T, 9) if len(u) else np.zeros((0, len(pivots)))
        best = cos.argmax(1)
        return pd.DataFrame({"home": best.astype(np.int32), "pivot": pivot_ids[best], "cosine": cos[np.arange(len(best)), best]})

    # Two cells per pivot: vectors similar to it (even numbers) and the others.
    placed = (distinct.withColumn("_c", nearest("u")).select("id", "u", "_c.*")
              .withColumn("cell", F.col("home") * 2 + (F.col("cosine") < threshold).cast("int")))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least")).collect()
    radius = {c["cell"]: math.acos(min(1.0, max(-1.0, c["least"]))) for c in cells}
    reach = math.acos(min(1.0, threshold)) + 1e-4
    between = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
    # Cells that must meet: at most (2 * MAX_PIVOTS) ** 2. Members of an even one hang together by their pivot.
    numbers = sorted(radius)
    width = np.array([radius[c] for c in numbers])
    home = np.array(numbers, dtype=int) // 2
    near = np.zeros((2 * len(pivots), 2 * len(pivots)), bool)
    near[np.ix_(numbers, numbers)] = between[np.ix_(home, home)] - width[:, None] - width[None, :] <= reach
    near[numbers, numbers] = [all_pairs or c % 2 == 1 for c in numbers]
    links = placed.filter((F.col("cell") % 2 == 0) & (F.col("id") != F.col("pivot"))).select(
        F.least("id", "pivot").alias("id_a"), F.greatest("id", "pivot").alias("id_b"), F.col("cosine").alias("score"))
    # Parts of crowded cells, dealt out by id hash, fill shares of bounded size. A row goes
    # to every share that holds a part of a cell it must meet, and meets those cells there.
    parts, shares = _filled({c["cell"]: c["n"] for c in cells}, share_rows(n, block_rows, pivots.shape[1]))
    holding = {cell: {share for (c, _), share in shares.items() if c == cell} for cell in parts}
    others = {cell: set().union(*(holding[d] for d in parts if near[cell, d])) for cell in parts}
    routes = [(cell, part, share, other) for (cell, part), share in shares.items() for other in others[cell]]
    routed = spark.createDataFrame(routes, "cell int, part int, share int, other int")
    sizes = spark.createDataFrame(list(parts.items()), "cell int, parts int")
    sent = (placed.select("id", "u", "cell").join(F.broadcast(sizes), "cell")
            .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
            .join(F.broadcast(routed), ["cell", "part"])
            .select(F.least("share", "other").alias("a"), F.greatest("share", "other").alias("b"),
                    (F.col("share") <= F.col("other")).alias("is_a"), "cell", "id", "u"))

    def meet(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        same = key[0] == key[1]
        ids, x, cell = group["id"].to_numpy(), matrix(group["u"]), group["cell"].to_numpy()
        is_a = group["is_a"].to_numpy()
        sides = [{c: np.flatnonzero(here & (cell == c)) for c in np.unique(cell[here])}
                 for here in ((is_a, is_a) if same else (is_a, ~is_a))]
        found = []
        for c, left in sides[0].items():
            for d, right in sides[1].items():
                if near[c, d] and (c <= d or not same):
                    found += _products(ids[left], x[left], ids[right], x[right], same and c == d, threshold)
        return _frame(found)

    met = sent.groupBy("a", "b").applyInPandas(meet, PAIRS)
    return (met if all_pairs else met.unionByName(links)).withColumn("score", F.round("score", 6))


def share_rows(n: int, block_rows: int, dims: int) -> int:
    """Rows that a task holds of each side: a share of all, so that sending grows with the rows and not with their square."""
    return max(block_rows, min(MOST_HELD, HELD_BYTES // (8 * dims), math.ceil(n / SHARES)))


def _filled(sizes: dict[int, int], room: int) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """(parts of each cell, share of each part): cells follow each other into shares of about `room` rows."""
    parts, shares, share, held = {}, {}, 0, 0
    for cell in sorted(sizes):
        parts[cell] = math.ceil(sizes[cell] / room)
        for part in range(parts[cell]):
            rows = sizes[cell] / parts[cell]
            if held and held + rows > 1.25 * room:
                share, held = share + 1, 0
            shares[cell, part], held = share, held + rows
    return parts, shares


def _products(ids_l: np.ndarray, x: np.ndarray, ids_r: np.ndarray, y: np.ndarray, same: bool, threshold: float,
              strip: int = 512) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lower id, higher id, score) of the pairs of a row of x and a row of y, each pair once if they are the `same` rows."""
    found = []
    for start in range(0, len(x), strip):
        score = np.round(x[start:start + strip] @ y.T, 9)
        i, j = np.nonzero(score >= threshold)
        a, b = ids_l[start:start + strip][i], ids_r[j]
        keep = a < b if same else np.ones(len(a), bool)
        found.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], score[i, j][keep]))
    return found


def _frame(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    a, b, score = zip(*found, strict=True) if found else [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    return pd.DataFrame({"id_a": np.concatenate(a), "id_b": np.concatenate(b), "score": np.concatenate(score)})


def bands_needed(threshold: float, band_bits: int) -> int:
    """Bands of so many signs that a pair at the threshold agrees on one of them but for a chance of MISSED."""
    # Two vectors are on one side of a random plane with chance 1 - angle / pi. Scores are rounded to nine places.
    alike = (1 - math.acos(threshold - 5e-10) / math.pi) ** band_bits
    return 1 if alike >= 1 - MISSED else math.ceil(math.log(MISSED) / math.log1p(-alike))


def banding(n: int, threshold: float, bucket_rows: int, bands: int | None = None, band_bits: int | None = None) -> tuple[int, int]:
    """(bands, signs per band) that find pairs at the threshold among `n` vectors with least work.

    More signs make smaller buckets and need more bands. A row is sent once per band and
    block it meets, and multiplied with the rows of its bucket. It is sent no more than
    MOST_SENT times if some number of signs allows that, else as seldom as can be. At low
    thresholds no signs at all can be cheapest: then one bucket holds all, cut into blocks.
    """
    def work(bits: int) -> float:
        crowd = n / 2 ** bits
        return bands_needed(threshold, bits) * (SENT * max(1.0, crowd / bucket_rows) + crowd / 2)

    def sent(bits: int) -> float:
        return bands_needed(threshold, bits) * max(1.0, n / 2 ** bits / bucket_rows)

    if band_bits is None:
        fit = [b for b in range(49) if bands is None or bands_needed(threshold, b) <= bands]
        few = [b for b in fit if sent(b) <= MOST_SENT] or [min(fit, key=sent)]
        band_bits = min(few, key=work)
    return bands_needed(threshold, band_bits) if bands is None else bands, band_bits


def _lsh_pairs(distinct: DataFrame, threshold: float, bands: int | None = None, band_bits: int | None = None,
               bucket_rows: int | None = None, seed: int = 17) -> DataFrame:
    """Vectors agreeing on all signs of a band.

    `bands` and `band_bits` follow the threshold and the number of vectors unless given
    (see `banding`). `bucket_rows` only cuts the work: a share of all rows unless given.
    """
    distinct = cut(distinct, "units")
    n, ids, dims = distinct.agg(F.count(F.lit(1)), F.count_distinct("id"), F.max(F.size("u"))).first()
    bucket_rows = bucket_rows or share_rows(n, 2_000, dims or 1)
    bands, band_bits = banding(n, threshold, bucket_rows, bands, band_bits)

    @F.pandas_udf("array<bigint>")
    def signatures(u: pd.Series) -> pd.Series:
        if len(u) == 0:
            return pd.Series([], dtype=object)
        x = matrix(u)
        planes = np.random.default_rng(seed).standard_normal((x.shape[1], bands * band_bits))
        bit, out = 1 << np.arange(band_bits, dtype=np.int64), []
        strip = max(1, (4 << 20) // max(1, bands * band_bits))
        for start in range(0, len(x), strip):
            rows = x[start:start + strip]
            out.extend((rows @ planes > 0).reshape(len(rows), bands, band_bits) @ bit)
        return pd.Series(out)

    signed = cut(distinct.select("id", "u", signatures("u").alias("keys")), "signed")
    counts = signed.select(F.posexplode("keys").alias("band", "key")).groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))
    crowded = broadcast_if_small(counts.filter(F.col("n") > bucket_rows).select("band", "key", F.ceil(F.col("n") / bucket_rows).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    placed = (signed.select("id", "u", F.posexplode("keys").alias("band", "key")).join(crowded, ["band", "key"], "left")
              .withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))))
    block = ["band", "key", "pa", "pb"]
    sent = placed.select("band", "key", F.least("part", "other").alias("pa"), F.greatest("part", "other").alias("pb"),
                         (F.col("part") <= F.col("other")).alias("is_a"), "id", "u")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Multiply blocks that arrive one after another; the last of a batch may go on in the next."""
        def settle(rows: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
            ids, x, is_a = rows["id"].to_numpy(), matrix(rows["u"]), rows["is_a"].to_numpy()
            same, found = (rows["pa"] == rows["pb"]).to_numpy(), []
            for begin, end in zip(begins, [*begins[1:], len(rows)], strict=True):
                here = np.arange(begin, end)
                left = here[is_a[here]]
                right = left if same[begin] else here[~is_a[here]]
                if len(left) and len(right):
                    found += _products(ids[left], x[left], ids[right], x[right], same[begin], threshold)
            return _frame(found)

        rest: list[pd.DataFrame] = []
        for batch in batches:
            rows = pd.concat([*rest, batch], ignore_index=True) if rest else batch
            if not len(rows):
                continue
            keys = rows[block].to_numpy()
            begins = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
            if len(begins) > 1:
                yield settle(rows[:begins[-1]], begins[:-1])
            rest = [rows[begins[-1]:]]
        if rest:
            yield settle(rest[0], np.zeros(1, np.int64))

    met = sent.repartition(*block).sortWithinPartitions(*block).mapInPandas(meet, PAIRS)
    if bands == 1 and ids == n:
        return met.withColumn("score", F.round("score", 6))
    # A pair may meet in many bands.
    return met.groupBy("id_a", "id_b").agg(F.round(F.max("score"), 6).alias("score"))


def lsh_recall(df: DataFrame, threshold: float, anchors: int = 200, features: str = "features", id_col: str = "id",
               **lsh) -> float:
    """Share of the exact pairs of some vectors with all others that `lsh` finds.

    The anchors are the vectors of lowest id hash, at most `anchors` of them; each is
    compared with every row, so buckets are as crowded as they are in use.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), unit(F.col(features)).alias("u")).filter(F.col("u").isNotNull())
    rows = rows.groupBy(F.xxhash64("u"), F.xxhash64(F.lit(1), "u")).agg(F.min_by("u", "id").alias("u"), F.min("id").alias("id"))
    rows = cut(rows.select("id", "u"), "units")
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(anchors).collect()
    if not chosen:
        return 1.0
    points, ids = np.array([r["u"] for r in chosen]), np.array([r["id"] for r in chosen], np.int64)

    def near(batches):
        for batch in batches:
            i, j = np.nonzero(np.round(matrix(batch["u"]) @ points.T, 9) >= threshold) if len(batch) else ([], [])
            a, b = batch["id"].to_numpy()[i], ids[j]
            yield pd.DataFrame({"id_a": np.minimum(a, b)[a != b], "id_b": np.maximum(a, b)[a != b]})

    exact = cut(rows.mapInPandas(near, "id_a bigint, id_b bigint").distinct(), "anchors")
    total = exact.count()
    found = cosine_pairs(df, threshold, features, id_col, mode="lsh", **lsh)
    return 1.0 if total == 0 else exact.join(found, ["id_a", "id_b"], "left_semi").count() / total
