"""Whitening of embeddings by the largest components of their covariance, found by contour integration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import Scratch

# Fixed points of a scheme of Gauss and Legendre on the upper half of a circle; the lower half mirrors it.
POINTS = 12
_SUMS = 32  # partial matrices that reach the driver at a time


# ---- eigenvalues of an interval (numpy, one small matrix) --------------------------

def inertia(a: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix, from the pivots of L D L' (Bunch and Parlett)."""
    a, positive = a.copy(), 0
    while len(a):
        off = np.abs(a - np.diag(np.diag(a)))
        r = int(np.abs(np.diag(a)).argmax())
        p, q = divmod(int(off.argmax()), len(a))
        if not a[r, r] and not off[p, q]:
            break
        if abs(a[r, r]) >= 0.6404 * off[p, q]:  # (1 + sqrt(17)) / 8
            pivot = [r]
            positive += a[r, r] > 0
        else:
            pivot = [p, q]
            det, trace = a[p, p] * a[q, q] - a[p, q] ** 2, a[p, p] + a[q, q]
            positive += 1 if det < 0 else 2 * int(trace > 0)
        rest = np.delete(np.arange(len(a)), pivot)
        b = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - b @ np.linalg.solve(a[np.ix_(pivot, pivot)], b.T)
        a = (a + a.T) / 2
    return positive


def above(v: np.ndarray, bound: float) -> int:
    """Eigenvalues above `bound`."""
    return inertia(v - bound * np.eye(len(v)))


def _bound(v: np.ndarray, k: int, low: float, high: float, steps: int = 44) -> float:
    """A number with at least k eigenvalues above it and, unless the k-th is as good as repeated, no more.

    It lies in the middle of the gap below the k-th eigenvalue, as far as bisection finds it.
    """
    floor, ceiling = low, high  # at least k above `floor`, fewer above `ceiling`
    for _ in range(steps):
        mid = (floor + ceiling) / 2
        if above(v, mid) >= k:
            floor = mid
        else:
            ceiling = mid
    kth = floor
    if above(v, low) == k:
        return low
    floor, ceiling = low, kth  # more than k above `floor`
    for _ in range(steps):
        mid = (floor + ceiling) / 2
        if above(v, mid) > k:
            floor = mid
        else:
            ceiling = mid
    middle = (floor + kth) / 2
    return middle if kth - floor > 1e-7 * high else floor - 1e-7 * high


def intervals(v: np.ndarray, low: float, high: float, count: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues) of parts of an interval that its eigenvalues fill well.

    Halves without eigenvalues are cut off. A part is halved again until some lie in
    three of its quarters, or there is one: the integral tells eigenvalues apart by their
    distance from the contour, as a share of its radius.
    """
    base = above(v, high)
    while count > 1 and high - low > 1e-6 * abs(high):
        below = [above(v, low + (high - low) * q / 4) - base for q in (1, 2, 3)]
        quarters = -np.diff([count, *below, 0])
        if (quarters > 0).sum() > 2:
            break
        mid = (low + high) / 2
        if below[1] == count:
            low = mid
        elif not below[1]:
            high = mid
        else:
            return intervals(v, mid, high, below[1]) + intervals(v, low, mid, count - below[1])
    return [(low, high, count)]


def project(v: np.ndarray, low: float, high: float, y: np.ndarray) -> np.ndarray:
    """Nearly the part of y in the eigenvectors of [low, high]: the resolvent integrated around the interval."""
    x, weights = np.polynomial.legendre.leggauss(POINTS)
    radius, centre, eye = (high - low) / 2, (high + low) / 2, np.eye(len(v))
    out = np.zeros_like(y)
    for angle, weight in zip(np.pi / 2 * (x + 1), weights, strict=True):
        step = radius * np.exp(1j * angle)
        out += weight / 2 * np.real(step * np.linalg.solve((centre + step) * eye - v, y.astype(complex)))
    return out


def interval_pairs(v: np.ndarray, low: float, high: float, count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenvalues, falling, and unit eigenvectors of (low, high), by FEAST (Polizzi 2009)."""
    size = min(len(v), 2 * count + 8)
    y = np.random.default_rng(seed).standard_normal((len(v), size))
    rounding = 4e-15 * len(v) * np.abs(v).sum(axis=1).max()
    for _ in range(40):
        q, _ = np.linalg.qr(project(v, low, high, y))
        values, turn = np.linalg.eigh(q.T @ v @ q)  # Rayleigh and Ritz
        y = q @ turn
        inside = (values > low) & (values < high)
        missed = np.linalg.norm(v @ y[:, inside] - y[:, inside] * values[inside], axis=0)
        if inside.sum() == count and missed.max(initial=0) <= rounding:
            break
    else:
        raise ArithmeticError(f"{int(inside.sum())} of {count} eigenvalues found between {low} and {high}")
    order = np.argsort(-values[inside])
    return values[inside][order], y[:, inside][:, order]


def largest_pairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors of a covariance matrix.

    Inertia counts the eigenvalues of every interval, and each must give as many as were
    counted. Eigenvalues of rounding size (10**-12 of the trace) count as zero and are
    left out, so there may be fewer than k.
    """
    d, trace = len(v), float(np.trace(v))
    least = 1e-12 * trace
    k = min(k, above(v, least)) if trace > 0 else 0
    if not k:
        return np.zeros(0), np.zeros((d, 0))
    high = float(np.abs(v).sum(axis=1).max()) * 1.01  # no eigenvalue is beyond the largest sum of a row
    low = max(_bound(v, k, least, high), least)
    vectors = [interval_pairs(v, *part)[1] for part in intervals(v, low, high, above(v, low))]
    # Vectors of neighbouring intervals are made orthogonal to each other as well.
    q, _ = np.linalg.qr(np.hstack(vectors))
    found, turn = np.linalg.eigh(q.T @ v @ q)
    order = np.argsort(-found)[:k]
    u = q @ turn[:, order]
    # Either sign is an eigenvector: the largest entry is positive, so that reruns agree.
    u *= np.where(u[np.abs(u).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return found[order], u


# ---- sums over all vectors -----------------------------------------------------------

def _rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _added(df: DataFrame, column: str, mean: np.ndarray) -> np.ndarray:
    """Sum of (x - mean)(x - mean)' over the rows' arrays `column`.

    One matrix per task, added up by number of partition before the driver adds the last few.
    """
    d = len(mean)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch, column) - mean
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m, np.float64) for m in t["m"].to_pylist())
        return pa.table({"m": pa.array([total.tobytes()], pa.binary())})

    parts = df.select(column).mapInArrow(partial, "m binary").withColumn("p", F.spark_partition_id() % _SUMS)
    sums = parts.groupBy("p").applyInArrow(lambda t: add(t), "m binary").collect()
    return sum((np.frombuffer(r["m"], np.float64).reshape(d, d) for r in sums), np.zeros((d, d)))


def _deviation(x: np.ndarray, n: int, totals: list[int]) -> list[int | None]:
    """Sum of (n * x - S)**2 of each row, exact; None if it is beyond a long."""
    most = n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, totals))
    wide = most * most * len(totals) >= 1 << 62
    away = x.astype(object if wide else np.int64) * n - np.array(totals, object if wide else np.int64)
    return [a if a < 1 << 63 else None for a in (away * away).sum(axis=1).tolist()]


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024,
           shift: int = 100_000) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): every vector in whitened components.

    Components c become x = floor(scale * c) + shift. The covariance of all n vectors x
    (divisor n, centred before multiplying) has unit eigenvectors, numbered from 1 by
    falling eigenvalue e; `whitened` is x less the mean, projected on one of them, over
    sqrt(e). `explained` is e's share of the trace, `deviation` the sum of squares of
    n * x - S over the vector (S: sums of x), null if it is beyond a long, and
    `identity_error` the largest entry of the covariance of `whitened` less the identity.

    Sums and products of all vectors are added up in tasks; the driver sees one matrix of
    dimension x dimension (some hundreds: 12 s at 200, 196 s at 600), whose eigenvectors it finds by contour
    integration with counts by inertia. Components without variance (10**-12 of the trace)
    have no rows: there are fewer than `components` for few or equal vectors, and none for one.

    Vectors that are null or hold null or non-finite components are dropped. Null and
    repeated ids are rows like others. All vectors must have one length.
    """
    scratch = Scratch(vectors.sparkSession)
    vec = F.col(vec_col)
    sound = F.forall(vec, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(vec, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift).cast("long"))
    rows = scratch.cut(vectors.select(F.col(id_col).cast("long").alias("id"), F.when(sound, x).alias("x")).filter("x IS NOT NULL"), "rows")
    schema = f"{id_col} bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    nothing = vectors.sparkSession.createDataFrame([], schema)
    n, d, most = rows.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
    if d != most:
        raise ValueError(f"vectors of different lengths, from {d} to {most}")
    if not n or not d:
        return nothing
    sums = (rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")))
    s = np.zeros(d, object)
    for r in sums.collect():
        s[r["i"]] = r["s"]
    mean = np.array([total / n for total in s.tolist()])
    v = _added(rows, "x", mean) / n
    e, u = largest_pairs((v + v.T) / 2, components)
    if not len(e):
        return nothing
    w, explained = u / np.sqrt(e), (e / np.trace(v)).tolist()
    totals = s.tolist()

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch, "x")
                out = (x - mean) @ w
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(e)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_deviation(x, n, totals), pa.int64()), lists], ["id", "deviation", "w"])

    white = scratch.cut(rows.mapInArrow(projected, "id bigint, deviation bigint, w array<double>"), "white")
    centre = np.array(white.agg(*[F.avg(F.col("w")[i]) for i in range(len(e))]).first())
    error = float(np.abs(_added(white, "w", centre) / n - np.eye(len(e))).max())
    share = F.array(*[F.lit(t) for t in explained])
    return (white.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
            .select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"),
                    "deviation", "whitened", F.get(share, F.col("at")).alias("explained"),
                    F.lit(error).alias("identity_error")))
