import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift.llm import topk

NAN, INF = float("nan"), float("inf")


def brute(rows, k, asks, scale):
    """Best k of every asking row, by (score, id, null last)."""
    sound = [(i, v, [int(np.floor(scale * x)) for x in vec]) for v, (i, vec) in enumerate(rows)
             if vec is not None and all(x is not None and np.isfinite(x) for x in vec)]
    out = []
    for q, me, x in sound:
        if q is not None and asks(q):
            scores = sorted((-sum(a * b for a, b in zip(x, y)), c is None, c or 0, other) for c, other, y in sound if other != me)
            out += [(q, r + 1, None if none else c, -s) for r, (s, none, c, _) in enumerate(scores[:k])]
    return sorted(out, key=str)


def run(spark, rows, k=3, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    df = df.selectExpr("*", "vec_id AS row", "vec_id AS q", "vec_id AS x", "vec_id AS id", "vec_id AS score", "vec_id AS `rank`")
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 5 == 0, k, scale=8, **kw).collect()), key=str)


@pytest.mark.parametrize("lists,depth,chunk,group", [(1, 4, 9, 4), (2, 4, 25, 7), (3, 2, 40, 100), (7, 16, 4096, 512)])
def test_equals_brute_force(spark, lists, depth, chunk, group):
    r = random.Random(lists)
    rows = [(i, [r.uniform(-2, 2) for _ in range(6)]) for i in range(90)]
    rows += [(100 + i, rows[5][1]) for i in range(60)]  # one vector on a third of all rows, queries among them
    rows += [(200 + i, [float(i % 3 == c) for c in range(6)]) for i in range(40)]  # ties, and scores of 0
    rows += [(10, rows[10][1]), (10, rows[3][1]), (None, rows[7][1]), (None, [2.0] * 6)]
    rows += [(300, None), (305, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (310, [NAN] * 6), (315, [INF, 0.0, 0.0, 0.0, 0.0, 0.0]), (320, [0.0] * 6)]
    got = run(spark, rows, lists=lists, depth=depth, chunk=chunk, group=group)
    assert got == brute(rows, 3, lambda q: q % 5 == 0, 8)


@pytest.mark.parametrize("size", [3e3, 1e7])
def test_large_components_stay_exact(spark, size):
    r = random.Random(1)
    rows = [(i, [r.uniform(-size, size) for _ in range(5)]) for i in range(60)]
    assert run(spark, rows) == brute(rows, 3, lambda q: q % 5 == 0, 8)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, [1.0])]) == []
    assert run(spark, [(5, [1.0]), (6, [2.0])]) == [(5, 1, 6, 128)]
    assert run(spark, [(1, [1.0]), (6, [2.0])]) == []
    assert run(spark, [(5, []), (6, [])]) == [(5, 1, 6, 0)]


def test_sums_beyond_a_long_are_refused(spark):
    with pytest.raises(Exception, match="OverflowError"):
        run(spark, [(5, [1e18, 1e18]), (6, [1e18, 1.0])])


def test_cutoff_leaves_out_most_entries(spark):
    """What is gathered in the second phase is a small part of all entries."""
    g = np.random.default_rng(3)
    x = g.standard_normal((2000, 64))
    rows, queries = np.round(50 * x), np.round(50 * x[:40])
    lists = [(queries[:, b::2] @ rows[:, b::2].T) for b in range(2)]
    u = {"rx": list(range(2000)), "rq": list(range(40)), "wx": 8, "wq": 8, "chunk": 0, "group": 0}
    tau = [(q, int(np.sort((queries @ rows.T)[q].astype(np.int64))[-6])) for q in range(40)]
    import pyarrow as pa
    batch = pa.RecordBatch.from_pylist([u | {"list": b, "tau": tau, "mx": rows[:, b::2].astype("<i8").tobytes(), "mq": queries[:, b::2].astype("<i8").tobytes()}
                                        for b in range(2)])
    given = topk._at_least(2)(batch)
    assert sum(len(a) // 4 for a in given["at"].to_pylist()) < 0.1 * 2 * 40 * 2000
    assert all((lists[b].ravel()[np.frombuffer(given["at"][b].as_py(), "<i4")] == np.frombuffer(given["score"][b].as_py(), "<i8")).all() for b in range(2))
