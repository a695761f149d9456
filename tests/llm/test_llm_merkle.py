import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from lumisift.llm import merkle
from lumisift.llm.common import Scratch


def h(text):
    return sha256(text.encode()).hexdigest()


def shown(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows):
    """Trees, proofs and folds of (doc_id, text, lang, source, n_chars) rows, run by run."""
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    leaf = lambda r, t: h("".join(map(shown, (r[0], r[3], r[2], r[4], t))))
    by = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, r[1].translate(lower) if hit and r[1] is not None else r[1])))
    ups = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        ups.append([x[2] for x in sorted(by[source])])

    def climb(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels
    trees = [climb(u) for u in ups]
    top = climb([t[-1][0] for t in trees])
    out = []
    for number, source in enumerate(sorted(by, key=lambda s: (s is not None, (s or "").encode()))):
        for pos, (known, doc, own, seen) in enumerate(sorted(by[source])):
            proof, folded = "", seen
            for levels, at in ((trees[number], pos), (top, number)):
                for level in levels[:-1]:
                    run = level[at // 16 * 16:at // 16 * 16 + 16]
                    proof += "".join(run[:at % 16] + run[at % 16 + 1:])
                    folded = h("".join([*run[:at % 16], folded, *run[at % 16 + 1:]]))
                    at //= 16
            out.append((doc if known else None, own, trees[number][-1][0], top[-1][0], h(proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def report(spark, rows, height=merkle.HEIGHT):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.selectExpr("*", *[f"doc_id AS `{c}`" for c in ("id", "tree", "pos", "size", "digest", "seen", "rank", "root", "block", "leaf")])
    return sorted(map(tuple, merkle.tampering_report(docs, height=height).collect()), key=str)


@pytest.mark.parametrize("height", [1, 2, 3])
def test_equals_brute_force(spark, height):
    r = random.Random(height)
    rows = []
    for source, n in (("hot", 700), ("a", 1), ("b", 16), ("c", 17), (None, 257), ("é", 2), ("Z", 256), ("", 33), ("\U0001F600", 3)):
        rows += [(len(rows) + i, r.choice(["Text", "text", "", None, "É" * 5, "x\x00Y", "L" * 3000]), r.choice(["en", None]), source, r.choice([1, None, 12])) for i in range(n)]
    rows += [rows[3], rows[3], (3, "Other", "en", "hot", 1), (None, "A", None, "hot", None), (None, "A", None, "hot", None), (None, None, None, None, None)]
    rows += [(10_000 + i, "t", "en", f"s{i}", 1) for i in range(40)]  # more sources than a run holds
    r.shuffle(rows)
    got = report(spark, rows, height)
    assert got == brute(rows)
    assert 0.05 < sum(not g[-1] for g in got) / len(got) < 0.3


def test_small_tables(spark):
    assert report(spark, []) == []
    only = report(spark, [(7, "Abc", "en", None, 3)])
    assert only == brute([(7, "Abc", "en", None, 3)]) and only[0][1] == only[0][2] == only[0][3]


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_fill_the_block_and_keep_subtrees_together(levels):
    places = [merkle.address(levels, d, np.arange(16 ** d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.tree_size(levels)))
    assert places[0][0] == 0
    if levels > 1:  # every subtree below the upper half is one run of places
        top = levels // 2
        for s in (0, 16 ** top - 1):
            below = np.concatenate([places[d].reshape(16 ** top, -1)[s] for d in range(top, levels)])
            assert below.max() - below.min() + 1 == len(below) == merkle.tree_size(levels - top)


def test_any_change_is_seen_and_stored_nodes_prove_leaves():
    leaves = [sha256(str(i).encode()).digest() for i in range(300)]
    nodes = merkle.lay_out(leaves, 3)
    levels, root = merkle.runs(nodes, 3, 300), nodes[:32].hex()
    for i in (0, 15, 16, 255, 256, 299):
        steps = merkle.path(levels, i)
        assert merkle.fold(leaves[i].hex(), steps) == root != merkle.fold(leaves[i - 1].hex(), steps)


def test_ranks(spark):
    rows = [(i * 37 % 500,) for i in range(500)]
    got = merkle.ranked(Scratch(spark), spark.createDataFrame(rows, "v int").repartition(7), merkle.F.col("v").desc()).collect()
    assert sorted((r["rank"], r["v"]) for r in got) == [(i, 499 - i) for i in range(500)]
