import numpy as np
import pytest

from lumisift.llm import whiten as wh

NAN = float("nan")


def vectors(n, d, seed=0, scales=None):
    g = np.random.default_rng(seed)
    return (g.standard_normal((n, d)) * (np.linspace(3, 0.2, d) if scales is None else scales)).astype(np.float32).astype(float)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    df = df.selectExpr("*", *[f"vec_id AS `{c}`" for c in ("id", "x", "n", "w", "component", "deviation", "at", "p")])
    return wh.whiten(df, **kw).collect()


def test_equals_dense_eigenvectors(spark):
    c = vectors(400, 20)
    bad = [(1000, None), (1001, [NAN] * 20), (1002, [None] * 20), (1003, [float("inf")] * 20)]
    rows = [(i, v.tolist()) for i, v in enumerate(c)] + bad + [(None, c[5].tolist()), (7, c[7].tolist())]
    got = run(spark, rows)
    c = np.vstack([c, c[5], c[7]])
    x = np.floor(1024 * c).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    e, u = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    e, u = e[::-1], u[:, ::-1]
    white = (x - s / n) @ u[:, :8] / np.sqrt(e[:8])
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    for j in range(8):
        sign = np.sign(white[0, j] * by[0, j + 1][0].whitened)
        for i in list(range(7)) + [8, 399]:
            if i != 5:
                assert by[i, j + 1][0].whitened == pytest.approx(sign * white[i, j], abs=1e-8)
                assert by[i, j + 1][0].deviation == deviation[i]
        assert by[0, j + 1][0].explained == pytest.approx(e[j] / e.sum(), rel=1e-10)
        assert len(by[7, j + 1]) == 2 and by[None, j + 1][0].whitened == by[5, j + 1][0].whitened
    assert {r.identity_error for r in got}.pop() < 1e-9 and len({r.identity_error for r in got}) == 1


def test_few_and_equal_vectors(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [] and run(spark, [(1, [1.0, 2.0])]) == []
    assert run(spark, [(i, [1.0, 2.0]) for i in range(9)]) == []
    got = run(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0])])
    assert [(r.vec_id, r.component, abs(round(r.whitened, 9)), r.deviation, r.explained) for r in sorted(got)] == [(1, 1, 1.0, 1024 ** 2, 1.0), (2, 1, 1.0, 1024 ** 2, 1.0)]
    assert {r.component for r in run(spark, [(i, v.tolist()) for i, v in enumerate(vectors(4, 12))])} == {1, 2, 3}


def test_vectors_of_different_lengths_are_refused(spark):
    with pytest.raises(ValueError, match="different lengths"):
        run(spark, [(1, [1.0]), (2, [1.0, 2.0])])


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 40, 0], [0, 1 << 40]], np.int64)
    assert wh._deviation(x, 2, [1 << 40, 1 << 40]) == [None, None]
    assert wh._deviation(x >> 20, 2, [1 << 20, 1 << 20]) == [1 << 41, 1 << 41]


@pytest.mark.parametrize("values", [
    np.arange(1, 41.0), np.r_[np.full(9, 5.0), np.arange(1, 5)], np.r_[5, 5, 5 - 1e-9, np.full(12, 1.0)], 10.0 ** -np.arange(0, 11.0), np.r_[7.0, np.zeros(5)],
    np.full(30, 2.0)])
@pytest.mark.parametrize("k", [1, 8, 20])
def test_contour_integration_finds_what_inertia_counts(values, k):
    q, _ = np.linalg.qr(np.random.default_rng(4).standard_normal((len(values), len(values))))
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    e, u = wh.largest_pairs(v, k)
    want = np.sort(values[values > 1e-12 * values.sum()])[::-1][:k]
    assert e == pytest.approx(want, rel=1e-9, abs=1e-12 * values.max())
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-10 and np.abs(v @ u - u * e).max() < 1e-10 * values.max()


def test_inertia():
    g = np.random.default_rng(8)
    for n in range(1, 12):
        a = g.standard_normal((n, n))
        a = a + a.T
        assert wh.inertia(a) == (np.linalg.eigvalsh(a) > 0).sum()
    assert wh.inertia(np.array([[0.0, 1], [1, 0]])) == 1 and wh.inertia(np.zeros((3, 3))) == 0


def test_projector_keeps_the_interval_only():
    v = np.diag(np.arange(1.0, 11))
    out = np.diag(wh.project(v, 6.5, 10.5, np.eye(10)))
    assert out[6:].min() > 0.4 and np.abs(out[:5]).max() < 0.01
