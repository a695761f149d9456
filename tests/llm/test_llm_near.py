import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift.llm import near
from lumisift.llm import text as tx


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def brute(rows, size, percent=80):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            linked = sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
            if None not in (rows[i][0], rows[j][0]) and (same or linked):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        mine = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        comp = None if doc is None else min(mine)
        out.append((doc, len(sets[i]), comp, doc is None or comp == doc))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_random_groups(make):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for doc in range(160):
        if rows and r.random() < 0.7:
            w = words(r.choice(rows)[1])
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        else:
            w = r.choices(vocabulary, k=r.choice([1, 2, 3, 5, 30, 80]))
        rows.append((doc, " ".join(w)))
    for size in (4, 5):
        assert found(near.near_duplicates(make(rows), shingle=size)) == brute(rows, size)


def test_crowd_of_linked_and_unlinked_texts(make):
    # One passage in many texts of the same size: similar sketches, few links.
    r = random.Random(5)
    shared = [f"s{i}" for i in range(40)]
    rows = [(i, " ".join(shared + [f"o{r.randrange(10 ** 6)}" for _ in range(r.choice([4, 20]))])) for i in range(150)]
    assert found(near.near_duplicates(make(rows), shingle=4)) == brute(rows, 4)


@pytest.mark.parametrize("rows_of_a_block", [7])
def test_crowded_buckets_compared_in_blocks(make, monkeypatch, rows_of_a_block):
    """Texts around a common one at all similarities, links between odd members among them."""
    monkeypatch.setattr(near, "CROWDED", 0)
    monkeypatch.setattr(near, "BLOCK_ROWS", rows_of_a_block)
    r = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for doc in range(140):
        w = words(r.choice(rows)[1]) if rows and r.random() < 0.4 else list(base)
        for _ in range(r.randrange(9)):
            w[r.randrange(len(w))] = f"o{r.randrange(10 ** 6)}"
        rows.append((doc, " ".join(w)))
    rows += [(500 + i, f"alone{i} " * 3 + "x y z") for i in range(20)] + [(0, rows[5][1]), (None, rows[3][1])]
    # Nothing is found pair by pair, so all links must come from the blocks.
    monkeypatch.setattr(near, "_verified", lambda scratch, pairs, *rest: pairs.select(F.col("ia").alias("id_a"), F.col("ib").alias("id_b")).limit(0))
    assert found(near.near_duplicates(make(rows[:-2]), shingle=4)) == brute(rows[:-2], 4)
    monkeypatch.undo()
    assert len(near.near_duplicates(make(rows), shingle=4).collect()) == len(rows)


def test_messy_and_empty(make, messy):
    assert found(near.near_duplicates(make(messy), shingle=4)) == brute(messy, 4)
    assert found(near.near_duplicates(make([]), shingle=4)) == []


@pytest.mark.parametrize("n", [1, 2, 7, 300, 5000])
def test_sketch_fills_and_estimates(n):
    rng = np.random.default_rng(n)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    b = np.concatenate([a[: int(n * 0.9)], rng.integers(0, 1 << 63, n - int(n * 0.9), dtype=np.uint64)])
    one, two = (near.sketch(np.zeros(n, np.int64), x, 1)[0] for x in (a, b))
    assert (one != near._EMPTY).all()
    real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((one == two).mean() - real) < 0.09
    again = near.sketch(np.zeros(n, np.int64), a[::-1].copy(), 1)[0]
    assert (again == one).all()


def test_word_hashes_do_not_depend_on_place():
    w = tx.Words([b"abc  abc\tABC", b"", b"abc"], tx.SPACE)
    assert len(set(w.hash.tolist())) == 1 and w.counts.tolist() == [3, 0, 1]
