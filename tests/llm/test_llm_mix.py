import random

import pytest

from lumisift.llm import mix


def test_targets_and_takings(make, messy):
    r = random.Random(2)
    rows = [(i, " ".join("w" * r.randrange(1, 60)), r.choice(["a", "b", "b", "b", None, "é", "z"])) for i in range(600)]
    rows += [(d if d is None else d + 5000, t, "m") for d, t in messy]
    docs = make([(d, t, s) for d, t, s in rows])
    got = mix.fair_mix(docs, [3, 1, 2]).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mix.fair_mix(docs.repartition(5), [3, 1, 2]).collect()), key=str)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    weights = dict(zip(sorted((s for s in sizes if s is not None)) + [None], [3, 1, 2] * 9))
    # Filling by bisection of the level.
    low, high = 0.0, 2.0 * sum(sizes.values())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * weights[s]) for s in sizes) < 1.5 * sum(sizes.values()) else (low, mid)
    by_size = {}
    for row in got:
        by_size.setdefault((row.source_size, round(row.target, 3)), []).append(row)
        assert 0 <= row.taken <= 2 * row.size and row.taken in (0, row.size, 2 * row.size)
    want = sorted((sizes[s], round(min(2 * sizes[s], low * weights[s]), 3)) for s in sizes)
    assert sum(sorted(by_size), ()) == pytest.approx(sum(want, ()))
    for (_, target), members in by_size.items():
        largest = max(m.size for m in members)
        assert abs(sum(m.taken for m in members) - target) <= 2 * largest + 2


def test_no_words_and_no_rows(make):
    assert [(r.taken, r.target) for r in mix.fair_mix(make([(1, None), (2, " ")]), [1]).collect()] == [(0, 0.0)] * 2
    assert mix.fair_mix(make([]), [3, 1, 2]).collect() == []
