"""Exact top-k inner products by three phases under one uniform threshold (Cao and Wang 2004).

A vector's components are dealt to `lists` lists; a list knows only its own part of
each inner product (the local score), and totals are sums over lists. Vectors lie in
chunks and queries in groups, both of bounded size, so a task holds one chunk's part
of one list against one group of queries, as matrices of whole numbers.

1. Every list gives each query its `depth` best local scores. The totals of the
   vectors found are resolved, and the k-th best of them is a safe cutoff tau: a vector
   with a total of tau or more has a local score of tau / lists or more in some list.
2. The cutoff goes to all lists, and each gives the entries at or above tau / lists.
   What no list gives is below tau. Totals known in full raise the cutoff once more.
3. Entries whose sum, with tau / lists for each list that is silent, can still reach the
   cutoff are resolved from the lists that have not given them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumisift.llm.common import Scratch, by_row

CHUNK, GROUP = 4096, 512  # vectors of a chunk and queries of a group, about
_STRIP = 64  # queries multiplied at a time


def whole(vec: Column, scale: float) -> Column:
    """floor(scale * x) of every component; null for a vector that is null or holds null or non-finite components."""
    sound = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.when(sound, F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


# ---- matrices of whole numbers as bytes -------------------------------------------

def _width(x: np.ndarray) -> int:
    """Bytes per number: the fewest of 2, 4 and 8 that hold all."""
    most = int(np.abs(x).max(initial=0))
    if most < 0 or most * most * max(1, x.shape[1]) >= 1 << 62:
        raise OverflowError("inner products of these vectors do not fit in a long")
    return 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8


def _pack(lists: int):
    """(part, row, id, x) rows of one part -> one row with its ids and, per list, its matrix."""
    def fn(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        lengths = np.unique(t["x"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
        if len(lengths) > 1:
            raise ValueError(f"vectors of different lengths: {lengths.tolist()[:5]}")
        flat = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(t.num_rows, -1) if len(flat) else np.zeros((t.num_rows, 0), np.int64)
        width = _width(x)
        mats = [np.ascontiguousarray(x[:, b::lists]).astype(f"<i{width}").tobytes() for b in range(lists)]
        return pa.table({"part": t["part"][:1], "width": pa.array([width], pa.int32()),
                         "rows": pa.array([t["row"].to_pylist()], pa.list_(pa.int64())),
                         "ids": pa.array([t["id"].to_pylist()], pa.list_(pa.int64())),
                         "mats": pa.array([mats], pa.list_(pa.binary()))})
    return fn


def _packed(rows: DataFrame, lists: int, most: int, count: int) -> DataFrame:
    parts = -(-max(1, count) // most)
    part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    return (rows.select(part.alias("part"), "row", "id", "x").groupBy("part")
            .applyInArrow(_pack(lists), "part int, width int, rows array<bigint>, ids array<bigint>, mats array<binary>"))


def _matrix(raw: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{width}").reshape(n, -1)


def _floats(q: np.ndarray, x: np.ndarray) -> type:
    """The cheapest numbers in which the products of q and x add up without rounding."""
    most = int(np.abs(q.astype(np.int64)).max(initial=0)) * int(np.abs(x.astype(np.int64)).max(initial=0)) * max(1, x.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def _strips(q: np.ndarray, x: np.ndarray):
    """(first query, scores of some queries against all of x)."""
    kind = _floats(q, x)
    q, x = q.astype(kind), x.astype(kind).T
    for i in range(0, len(q), _STRIP):
        yield i, q[i:i + _STRIP] @ x


def _units(chunks: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Every list of every chunk with the same list of every group of queries."""
    a = (chunks.select(F.col("part").alias("chunk"), F.col("width").alias("wx"), F.col("rows").alias("rx"), F.posexplode("mats").alias("list", "mx"))
         .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))))
    keep = [c for c in ("tau",) if c in groups.columns]
    b = groups.select(F.col("part").alias("group"), F.col("width").alias("wq"), F.col("rows").alias("rq"), *keep, F.posexplode("mats").alias("list", "mq"))
    return a.join(b, ["group", "list"])


# ---- the phases -----------------------------------------------------------------

def _best_local(depth: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[np.ndarray, ...]] = []
        for u in batch.to_pylist():
            rx, rq = np.array(u["rx"], np.int64), np.array(u["rq"], np.int64)
            q, x = _matrix(u["mq"], u["wq"], len(rq)), _matrix(u["mx"], u["wx"], len(rx))
            take = min(depth, len(rx))
            for i, s in _strips(q, x):
                at = np.argpartition(-s, take - 1, axis=1)[:, :take] if take < len(rx) else np.broadcast_to(np.arange(take), (len(s), take))
                out.append((np.repeat(rq[i:i + len(s)], take), np.full(at.size, u["list"]), rx[at].ravel(),
                            np.take_along_axis(s, at, 1).ravel().astype(np.int64)))
        q, b, row, score = (np.concatenate(p) for p in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(b, pa.int32()), pa.array(row), pa.array(score)], ["q", "list", "row", "score"])
    return fn


def _cutoffs(tau: dict | list | None, rq: np.ndarray, none: int) -> np.ndarray:
    known = dict(tau or [])
    return np.array([none if known.get(q) is None else known[q] for q in rq.tolist()], np.int64)


_LEAST = -(1 << 62)  # stands for "no cutoff"


def _at_least(lists: int):
    """Entries at or above tau / lists, as one row of packed places and scores per unit."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for u in batch.to_pylist():
            rq, n = np.array(u["rq"], np.int64), len(u["rx"])
            q, x = _matrix(u["mq"], u["wq"], len(rq)), _matrix(u["mx"], u["wx"], n)
            floor = -(-_cutoffs(u["tau"], rq, _LEAST) // lists)
            at, score = [], []
            for i, s in _strips(q, x):
                a, b = np.nonzero(s >= floor[i:i + len(s), None])
                at.append((a + i) * n + b)
                score.append(s[a, b].astype(np.int64))
            rows.append((u["chunk"], u["group"], u["list"], np.concatenate(at).astype("<i4").tobytes(), np.concatenate(score).astype("<i8").tobytes()))
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["chunk", "group", "list", "at", "score"])
    return fn


def _summed(lists: int):
    """Per chunk and group: place, sum of the scores given, and the lists that gave them as bits."""
    def fn(t: pa.Table) -> pa.Table:
        at = [np.frombuffer(a, "<i4") for a in t["at"].to_pylist()]
        score = [np.frombuffer(s, "<i8") for s in t["score"].to_pylist()]
        bits = np.repeat(np.left_shift(np.int64(1), t["list"].to_numpy().astype(np.int64)), [len(a) for a in at])
        place, back = np.unique(np.concatenate(at), return_inverse=True)
        total, seen = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        np.add.at(total, back, np.concatenate(score))
        np.add.at(seen, back, bits)
        return pa.table({"chunk": t["chunk"][:1], "group": t["group"][:1], "at": pa.array([place.astype("<i4").tobytes()]),
                         "total": pa.array([total.tobytes()]), "seen": pa.array([seen.tobytes()])})
    return fn


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of every query: by score, then id, then row."""
    order = np.lexsort((rows, ids, -score, q))
    q = q[order]
    start = np.searchsorted(q, q)
    return order[np.arange(len(q)) - start < k]


_NO_ID = np.iinfo(np.int64).max


def _ids(raw: list) -> np.ndarray:
    return np.array([_NO_ID if i is None else i for i in raw], np.int64)


def _resolved(lists: int, k: int, complete: bool):
    """The k best totals of each query in a chunk.

    `complete`: of the entries that all lists gave, no other list being asked. Otherwise
    of all that can still reach `tau2`, the missing local scores worked out.
    """
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for u in batch.to_pylist():
            rx, rq, ids = np.array(u["rx"], np.int64), np.array(u["rq"], np.int64), _ids(u["ids"])
            place, total, seen = np.frombuffer(u["at"], "<i4").astype(np.int64), np.frombuffer(u["total"], "<i8"), np.frombuffer(u["seen"], "<i8")
            if complete:
                keep = seen == (1 << lists) - 1
            else:
                tau, tau2 = _cutoffs(u["tau"], rq, _LEAST), _cutoffs(u["tau2"], rq, _LEAST)
                silent = lists - np.bitwise_count(seen.astype(np.uint64)).astype(np.int64)
                a = place // len(rx)
                # A list that is silent holds less than tau / lists; there is none without a cutoff.
                keep = (silent == 0) & (total >= tau2[a]) | (silent > 0) & (total + silent * (-(-tau[a] // lists) - 1) >= tau2[a])
            place, total, seen = place[keep], total[keep].copy(), seen[keep]
            a, b = place // len(rx), place % len(rx)
            if not complete:
                for i in range(lists):
                    ask = np.flatnonzero(seen >> i & 1 == 0)
                    x, q = _matrix(u["mats"][i], u["wx"], len(rx)), _matrix(u["qmats"][i], u["wq"], len(rq))
                    for s in range(0, len(ask), 1 << 16):
                        at = ask[s:s + (1 << 16)]
                        total[at] += np.einsum("ij,ij->i", q[a[at]].astype(np.int64), x[b[at]].astype(np.int64))
            top = _best(a, total, ids[b], rx[b], k)
            out.append((rq[a[top]], total[top], ids[b[top]], rx[b[top]]))
        q, total, ids, rows = (np.concatenate(p) for p in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(total), pa.array(ids, mask=ids == _NO_ID), pa.array(rows)], ["q", "score", "id", "row"])
    return fn


def _kth(totals: DataFrame, k: int) -> DataFrame:
    """(q, tau): the k-th best total of every query that has so many."""
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "row"))
    return (totals.withColumn("nth", nth).filter(F.col("nth") <= k).groupBy("q")
            .agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("tau")).filter(F.col("n") == k).select("q", "tau"))


def _with_cutoffs(groups: DataFrame, tau: DataFrame, name: str) -> DataFrame:
    """Add a map from query to cutoff to every group."""
    members = groups.select("part", F.explode("rows").alias("q")).join(tau, "q")
    maps = members.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("q", "tau"))).alias(name))
    return groups.join(maps, "part", "left")


def top_k(candidates: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: float = 256, lists: int = 2, depth: int = 16, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, id_col, score): the k best rows by inner product for every row for which `queries` holds.

    Components become floor(scale * x); scores are whole and exact, and a score that
    could leave the range of a long raises an error. A query's own row is no candidate.
    Ties go to the smaller id, null last. With fewer candidates than k, all are
    returned; without candidates or queries, no rows.

    Vectors that are null or hold null or non-finite components take no part. Rows that
    repeat an id are rows like others. All vectors must have one length.

    Of equal vectors, only the k + 1 lowest ids can be among the best, and equal queries
    have the same k + 1 best, so copies are neither multiplied nor gathered; both cuts
    are exact. The work is one multiplication per component of each different query and
    candidate, in blocks; what is sent between phases is a few entries of each block.
    """
    if not 1 <= lists <= 62:
        raise ValueError("lists must lie between 1 and 62")
    scratch = Scratch(candidates.sparkSession)
    named = candidates.select(F.col(id_col).cast("long").alias("id"), whole(F.col(vec_col), scale).alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = scratch.cut(named.filter("x IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "rows")
    nth = F.row_number().over(Window.partitionBy("x").orderBy(F.col("id").asc_nulls_last(), "row"))
    different = scratch.cut(rows.select("row", "id", "x").withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth"), "different")
    asking = scratch.cut(rows.filter("asks").groupBy("x").agg(F.min("row").alias("row")).withColumn("id", F.col("row")), "asking")
    n_asking = asking.count()
    n_groups = -(-max(1, n_asking) // group)
    chunks = scratch.cut(_packed(different, lists, chunk, different.count()), "chunks")
    groups = scratch.cut(_packed(asking, lists, group, n_asking), "groups")

    local = by_row(_units(chunks, groups, n_groups), _best_local(depth), "q bigint, list int, row bigint, score bigint")
    nth = F.row_number().over(Window.partitionBy("q", "list").orderBy(F.desc("score"), "row"))
    # One row per query and row found: lists give a total but once.
    found = local.withColumn("nth", nth).filter(F.col("nth") <= depth).select("q", "row").distinct()
    product = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, v: s + v)
    totals = (found.join(different.select("row", "x"), "row").join(asking.select(F.col("row").alias("q"), F.col("x").alias("y")), "q")
              .select("q", "row", product.alias("score")))
    tau = scratch.cut(_kth(totals, k + 1), "tau")

    cut = scratch.cut(_with_cutoffs(groups, tau, "tau"), "cutoffs")
    given = by_row(_units(chunks, cut, n_groups), _at_least(lists), "chunk int, group int, list int, at binary, score binary")
    entries = scratch.cut(given.groupBy("chunk", "group").applyInArrow(_summed(lists), "chunk int, group int, at binary, total binary, seen binary"), "entries")

    wide = chunks.select(F.col("part").alias("chunk"), F.col("width").alias("wx"), F.col("rows").alias("rx"), "ids", "mats")
    kinds = "q bigint, score bigint, id bigint, row bigint"
    known = entries.join(wide.drop("mats"), "chunk").join(groups.select(F.col("part").alias("group"), F.col("rows").alias("rq")), "group")
    better = _kth(by_row(known, _resolved(lists, k + 1, True), kinds), k + 1)
    higher = tau.unionByName(better).groupBy("q").agg(F.max("tau").alias("tau"))
    asked = _with_cutoffs(cut, higher, "tau2")
    asked = asked.select(F.col("part").alias("group"), F.col("width").alias("wq"), F.col("rows").alias("rq"), F.col("mats").alias("qmats"), "tau", "tau2")
    totals = by_row(entries.join(wide, "chunk").join(asked, "group"), _resolved(lists, k + 1, False), kinds)
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row"))
    best = scratch.cut(totals.withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth"), "best")

    # Equal queries share a list; each row that asks leaves itself out.
    askers = rows.filter("asks").join(asking.select("x", F.col("row").alias("q")), "x").select("q", F.col("id").alias("query_id"), F.col("row").alias("asker"))
    nth = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row"))
    return (askers.join(best, "q").filter(F.col("row") != F.col("asker")).withColumn("rank", nth).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
