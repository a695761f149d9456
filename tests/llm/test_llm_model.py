import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from lumisift.llm import pitmanyor as py
from lumisift.llm.common import table


def tokens(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [w for w in low.split()] + [None]


def check_base(rows, got):
    train = Counter(t for d, x in rows if zlib.crc32(str(d if d is not None else "").encode()) % 10 for t in tokens(x))
    n, v = sum(train.values()), len(train)
    want = sorted(((d, zlib.crc32(str(d if d is not None else "").encode()) % 10 == 0, len(tokens(x)), sum(t in train for t in tokens(x)), n,
                    round(sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x)), 4)) for d, x in rows), key=str)
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=str)
    assert have == want
    assert all(math.isfinite(r.score) and r.score < 0 and r.perplexity >= 1 for r in got)


def test_counts_and_base_score(make, messy):
    got = py.score_texts(make(messy)).collect()
    check_base(messy, got)
    assert py.score_texts(make([])).collect() == []


def test_many_blocks_and_parts_and_split_words(spark, make, monkeypatch):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    docs = make(rows).coalesce(2)
    whole = py.score_texts(docs).collect()
    check_base(rows, whole)
    monkeypatch.setattr(py, "BLOCK_BYTES", 20_000)
    cut = py.score_texts(docs, part_entries=9_000, heavy=300).collect()
    check_base(rows, cut)
    by_id = {r.doc_id: r.score for r in whole}
    # Other seatings, the same model.
    assert sum(r.score for r in cut) == pytest.approx(sum(by_id.values()), rel=0.01)


def test_better_than_the_base_on_held_out_texts(spark):
    got = [r for r in py.score_texts(table(spark, "/root/testdata/sf0.01", "documents")).collect() if r.held_out]
    assert sum(r.score for r in got) > 1.02 * sum(r.base_score for r in got)


def test_probabilities_of_all_next_words_add_up_to_one(make):
    # Texts of one word over a known vocabulary: the end follows every word.
    rows = [(i, " ".join(w)) for i, w in enumerate(product("abc", repeat=2))] + [(100 + i, w) for i, w in enumerate(["a", "b", "c", "unseen"])]
    got = {r.doc_id: 10 ** r.score for r in py.score_texts(make([*rows, (500, "a"), (501, "b")])).collect()}
    assert all(0 < p < 1 for p in got.values())
    assert got[500] == pytest.approx(got[100], rel=1e-9)


def crp(customers, others, base, level):
    """Distribution of the number of tables by seating customer after customer, all of one dish, in every way."""
    weight = {(): 1.0}
    for _ in range(customers):
        new = Counter()
        for sizes, w in weight.items():
            for k in range(len(sizes)):
                new[(*sizes[:k], sizes[k] + 1, *sizes[k + 1:])] += w * (sizes[k] - level.discount)
            new[(*sizes, 1)] += w * (level.strength + level.discount * (others + len(sizes))) * base
        weight = new
    out = Counter()
    for sizes, w in weight.items():
        out[len(sizes)] += w
    total = sum(out.values())
    return [out[t] / total for t in range(1, customers + 1)]


@pytest.mark.parametrize("customers,others,base", [(2, 0, 0.3), (4, 7, 0.05), (6, 3, 0.5)])
def test_tables_follow_the_seating_of_customers(customers, others, base):
    level, n = py.Restaurant(0.6, 1.5), 40_000
    rng = np.random.default_rng(1)
    t = py.seat(np.full(n, customers), np.full(n, others), np.full(n, base), level, rng, py.stirling(level.discount, py.SMALL))
    share = np.bincount(t, minlength=customers + 1)[1:] / n
    assert np.abs(share - crp(customers, others, base, level)).max() < 0.012


def test_many_customers_are_seated_within_bounds():
    level = py.Restaurant(0.7, 2.0)
    c = np.array([49, 500, 100_000])
    t = py.seat(c, np.array([5, 50, 500]), np.array([0.01, 0.2, 0.5]), level, np.random.default_rng(0), py.stirling(0.7, py.SMALL))
    assert (t >= 1).all() and (t <= c).all() and t[2] > t[1] > t[0]
