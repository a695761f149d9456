import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumisift.functions import hashing as hs
from lumisift.operators import cosine, exact, fingerprints, groups, hamming, jaccard
from lumisift.operators.groups import duplicate_groups


def pairs(df, *extra):
    return sorted(tuple(r[c] for c in ("id_a", "id_b", *extra)) for r in df.collect())


def brute_hamming(values, k):
    """Pairs of distinct hashes through their lowest ids, and a link per further copy."""
    first = {}
    for i, h in sorted(values):
        first.setdefault(h, i)
    out = [(first[h], i, 0) for i, h in values if first[h] != i]
    items = sorted(first.items(), key=lambda x: x[1])
    for n, (h, i) in enumerate(items):
        for g, j in items[n + 1:]:
            d = bin((h ^ g) & (1 << 64) - 1).count("1")
            if d <= k:
                out.append((i, j, d))
    return sorted(out)


@pytest.mark.parametrize("bucket_rows", [2000, 1])
@pytest.mark.parametrize("k, bits", [(0, 64), (2, 64), (3, 60), (5, 64)])
def test_hamming_equals_brute_force(spark, k, bits, bucket_rows):
    rng = random.Random(k)
    centres = [rng.getrandbits(bits) for _ in range(12)]
    values = []
    for i in range(160):
        h = rng.choice(centres)
        for _ in range(rng.randint(0, 4)):
            h ^= 1 << rng.randrange(bits)
        values.append((i, h - (1 << 64) if h >= 1 << 63 else h))
    df = spark.createDataFrame(values + [(999, None)], "id bigint, hash bigint").repartition(3)
    assert pairs(hamming.hamming_pairs(df, k, bits, bucket_rows=bucket_rows), "distance") == brute_hamming(values, k)


def test_crowded_band_stays_exact(spark):
    # A third of all hashes agree on the first 45 bits, hence on three of four bands.
    rng = random.Random(5)
    values = [(i, rng.getrandbits(15) if i % 3 == 0 else rng.getrandbits(60)) for i in range(900)]
    df = spark.createDataFrame(values, "id bigint, hash bigint")
    assert pairs(hamming.hamming_pairs(df, 3, 60, bucket_rows=20), "distance") == brute_hamming(values, 3)


def test_more_rows_mean_longer_keys():
    assert hamming.choose_blocks(1_000, 3, 60) == 4
    for rows in (10**6, 10**8, 10**10):
        blocks = hamming.choose_blocks(rows, 3, 60)
        assert rows / 2 ** int(60 * (blocks - 3) / blocks) <= 17
        assert hamming.finer_blocks(blocks, 3, 60) > blocks


def test_copies_cost_one_link_each(spark):
    df = spark.range(3000).select("id", F.lit(7).cast("bigint").alias("hash"))
    got = hamming.hamming_pairs(df, 3, 60)
    assert got.count() == 2999 and got.agg(F.max("id_a")).first()[0] == 0
    texts = spark.range(2000).select("id", F.lit("one two three").alias("text"))
    assert jaccard.jaccard_pairs(texts, hs.words(F.col("text")), 0.8).count() == 1999


def test_simhash_counts_occurrences(spark):
    import hashlib

    text = "a b b c"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "b")], "id bigint, text string")
    got = {r["id"]: r["hash"] for r in fingerprints.simhash(df, hs.words(F.col("text"))).collect()}
    votes = [0] * 60
    for w in text.split():
        h = int(hashlib.md5(w.encode()).hexdigest()[:15], 16)
        for i in range(60):
            votes[i] += 1 if h >> i & 1 else -1
    assert got == {1: sum(1 << i for i in range(60) if votes[i] > 0), 4: int(hashlib.md5(b"b").hexdigest()[:15], 16)}


def test_simhash_hashes_a_token_once_a_batch(spark):
    """Tokens are not exploded; nulls count as tokens without bits, rows of one id are one text, however the counters are cut up."""
    rows = [(1, ["a", None, "b"]), (1, ["a"]), (2, []), (3, None), (4, [None]), (5, ["é", "日本", ""]), (None, ["x", "y"]), (6, ["z"] * 50 + ["a"] * 49)]
    df = spark.createDataFrame(rows, "id int, t array<string>").coalesce(1)
    want = {}
    for i, tokens in rows:
        want.setdefault(i, []).extend(tokens or [])
    hashes = {i: [0 if t is None else int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in tokens] for i, tokens in want.items() if tokens}
    want = {i: sum(1 << b for b in range(60) if 2 * sum(h >> b & 1 for h in found) > len(found)) for i, found in hashes.items()}
    got = fingerprints.simhash(df, F.col("t"))
    assert {r["id"]: r["hash"] for r in got.collect()} == want
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held", [1, 4, 10**6])
def test_counters_are_the_same_in_any_slices(monkeypatch, held):
    tokens = [["a", "b"], [], ["c"], None, ["a"] * 9, [None, "d"]]
    batch = pa.RecordBatch.from_arrays([pa.array([*range(6)]), pa.array(tokens, pa.list_(pa.string()))], ["id", "_t"])
    whole = pa.Table.from_batches(fingerprints._token_votes(iter([batch])))
    monkeypatch.setattr(fingerprints, "_HELD_TOKENS", held)
    assert pa.Table.from_batches(fingerprints._token_votes(iter([batch]))).combine_chunks().equals(whole.combine_chunks())
    assert whole["id"].to_pylist() == [0, 2, 4, 5] and whole["_n"].to_pylist() == [2, 1, 9, 2]


def brute_jaccard(sets, percent):
    first = {}
    for i, s in sorted(sets):
        if s:
            first.setdefault(frozenset(s), i)
    out = [(first[frozenset(s)], i) for i, s in sets if s and first[frozenset(s)] != i]
    items = sorted(first.items(), key=lambda x: x[1])
    for n, (a, i) in enumerate(items):
        out += [(i, j) for b, j in items[n + 1:] if 100 * len(a & b) >= percent * len(a | b)]
    return sorted(out)


@pytest.mark.parametrize("bucket_rows, broadcast_bytes", [(5000, 10**6), (3, 10**6), (3, 5)])
@pytest.mark.parametrize("percent", [30, 60, 80, 100])
def test_jaccard_equals_brute_force(spark, percent, bucket_rows, broadcast_bytes):
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(40)]
    base = [rng.sample(words, rng.randint(1, 14)) for _ in range(15)]
    sets = []
    for i in range(120):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            s ^= {rng.choice(words)}
        sets.append((i, s))
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in sets], "id bigint, text string").repartition(3)
    got = jaccard.jaccard_pairs(df, hs.words(F.col("text")), percent / 100, bucket_rows=bucket_rows, broadcast_bytes=broadcast_bytes)
    assert pairs(got) == brute_jaccard(sets, percent)


def test_sets_too_far_apart_never_become_candidates(spark):
    """They share a rare word but little else: their number grows with the square of the rows."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    sets = [(i, set(rng.sample(words, 30)) | {f"x{i % 3}"}) for i in range(120)]
    sets += [(200 + i, (s - {sorted(s)[0]}) | {f"y{i % 2}"}) for i, s in sets[:20]]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets], "id bigint, s array<string>")
    ranked = jaccard._ranked_sets(df, 80, 10**6).cache()
    found = jaccard._candidates(ranked, 80, 5000, True).select(F.least("ia", "ib"), F.greatest("ia", "ib")).distinct()
    want = {p[:2] for p in brute_jaccard(sets, 80)}
    assert len(want) >= 20 and {tuple(r) for r in found.collect()} == want


def test_only_rows_of_rarer_words_are_shuffled(spark, monkeypatch):
    """A vocabulary too large to be sent to every task: its commonest words still are."""
    sets = [(i, {"a", "b", "c", "d", "e", f"p{i}", f"q{i // 2}"}) for i in range(200)]
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in sets], "id bigint, text string")
    seen, real = [], jaccard.salted_join
    monkeypatch.setattr(jaccard, "salted_join", lambda rows, *a: seen.append(rows) or real(rows, *a))
    got = jaccard.jaccard_pairs(df, hs.words(F.col("text")), 0.8, broadcast_bytes=400)
    assert pairs(got) == brute_jaccard(sets, 80)
    assert [rows.count() for rows in seen] == [400]


def test_word_on_every_row(spark):
    # One token on all rows, so its bucket holds everything, and few similar sets.
    rng = random.Random(2)
    sets = [(i, {"the", *(f"w{rng.randrange(30)}" for _ in range(3))}) for i in range(150)]
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in sets], "id bigint, text string")
    assert pairs(jaccard.jaccard_pairs(df, hs.words(F.col("text")), 0.6, bucket_rows=10)) == brute_jaccard(sets, 60)


@pytest.mark.parametrize("kept", [18, 20])
@pytest.mark.parametrize("percent", [40, 70])
def test_links_of_a_crowd_give_the_same_groups(spark, percent, kept):
    # A third of the rows are near copies of one text, each with words of its own.
    rng = random.Random(percent)
    template, sets = [f"t{i}" for i in range(20)], []
    for i in range(600):
        if i % 3 == 0:
            sets.append((i, set(rng.sample(template, kept)) | {f"u{rng.randrange(60)}" for _ in range(2)}))
        else:
            sets.append((i, set(rng.sample(template, 6)) | {f"v{rng.randrange(40)}" for _ in range(rng.randint(1, 12))}))
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in sets], "id bigint, text string")
    every = brute_jaccard(sets, percent)
    got = pairs(jaccard.jaccard_pairs(df, hs.words(F.col("text")), percent / 100, all_pairs=False, bucket_rows=25))
    assert len(got) == len(set(got)) and set(got) <= set(every)
    assert components(got) == components(every)
    if kept == 20:  # one crowd, so a link or two per member instead of all its pairs
        assert len(got) < len(every) / 3
    else:
        assert len(got) < len(every)


@pytest.mark.parametrize("bucket_rows", [5000, 3])
def test_minhash_mode_gives_real_scores(spark, bucket_rows):
    sets = [(i, {f"w{j}" for j in range(i % 5, i % 5 + 20)} | {f"x{i}"}) for i in range(40)]
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in sets] + [(99, None), (98, "")], "id bigint, text string")
    got = pairs(jaccard.jaccard_pairs(df, hs.words(F.col("text")), 0.8, mode="lsh", bucket_rows=bucket_rows))
    want = brute_jaccard(sets, 80)
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)


def test_minhash_finds_the_pairs_of_the_query(spark):
    """At the query's threshold and on its table: a subset of the exact pairs, nine tenths of them at least."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id AS id", "text")
    tokens = hs.words(F.col("text"))
    exact, near = (pairs(jaccard.jaccard_pairs(df, tokens, 0.8, mode=m), "score") for m in ("exact", "lsh"))
    assert set(near) <= set(exact) and len(near) >= 0.9 * len(exact) > 0
    assert jaccard.minhash_recall(df, tokens, 0.8) >= 0.9


@pytest.mark.parametrize("percent", [1, 30, 50, 80, 95, 100])
def test_minhash_bands_follow_the_threshold(percent):
    bands, rows = jaccard.minhash_bands(percent)
    assert bands * rows <= jaccard.MOST_HASHES
    if percent >= 3:
        assert 1 - (1 - (percent / 100) ** rows) ** bands >= 0.99


def vectors(n, seed, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    v = centres[rng.integers(0, 6, n)] + 0.15 * rng.standard_normal((n, dims))
    v[n // 2] = v[1]
    v[3] = 0
    return v


@pytest.mark.parametrize("block_rows", [4096, 17])
@pytest.mark.parametrize("threshold", [0.5, 0.97])
def test_cosine_equals_brute_force(spark, threshold, block_rows):
    v = vectors(200, 3)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(500, None)], "id bigint, features array<double>")
    got = pairs(cosine.cosine_pairs(df, threshold, block_rows=block_rows))
    norm = np.linalg.norm(v, axis=1)
    live = [i for i in range(200) if norm[i] > 0 and i != 100]
    want = [(i, j) for n, i in enumerate(live) for j in live[n + 1:] if round(v[i] @ v[j] / (norm[i] * norm[j]), 9) >= threshold]
    assert got == sorted(want + [(1, 100)])


def test_cosine_links_give_the_same_groups(spark):
    v = vectors(240, 9)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id bigint, features array<double>")
    every = pairs(cosine.cosine_pairs(df, 0.95, block_rows=20))
    some = pairs(cosine.cosine_pairs(df, 0.95, all_pairs=False, block_rows=20))
    assert set(some) <= set(every) and len(some) < len(every) and components(some) == components(every)


def sendings(monkeypatch, kind, name):
    """Calls of a DataFrame method that deals rows out; each as the frame that it is called on."""
    seen, real = [], getattr(kind, name)
    monkeypatch.setattr(kind, name, lambda self, *a: seen.append(self) or real(self, *a))
    return seen


@pytest.mark.parametrize("mode", ["exact", "lsh"])
def test_cosine_sends_a_row_a_bounded_number_of_times(spark, monkeypatch, mode):
    """With blocks of a fixed size a row would be sent to as many as there are: the square of the rows."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((3000, 8)))], "id bigint, features array<double>")
    blocks = {"block_rows": 16} if mode == "exact" else {}
    if mode == "lsh":
        monkeypatch.setattr(cosine, "share_rows", lambda n, least, dims, real=cosine.share_rows: real(n, 16, dims))
    seen = sendings(monkeypatch, type(df), "groupBy" if mode == "exact" else "repartition")
    found = pairs(cosine.cosine_pairs(df, 0.35, mode=mode, **blocks))
    sent = [frame.count() for frame in seen if "is_a" in frame.columns]
    assert len(sent) == 1 and sent[0] <= 3000 * cosine.MOST_SENT
    if mode == "exact":
        u = np.array([r["features"] for r in df.orderBy("id").collect()])
        u /= np.linalg.norm(u, axis=1)[:, None]
        assert found == [(int(i), int(j)) for i, j in np.argwhere(np.triu(np.round(u @ u.T, 9) >= 0.35, 1))]


def test_cosine_lsh_recall(spark):
    v = vectors(300, 4)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id bigint, features array<double>")
    full = set(pairs(cosine.cosine_pairs(df, 0.97), "score"))
    near = set(pairs(cosine.cosine_pairs(df, 0.97, mode="lsh", bands=24, band_bits=8), "score"))
    assert near <= full and len(near) > 0.9 * len(full)
    assert cosine.lsh_recall(df, 0.97, bands=24, band_bits=8) > 0.9
    # What is found does not depend on how buckets are cut.
    cut_small = set(pairs(cosine.cosine_pairs(df, 0.97, mode="lsh", bands=24, band_bits=8, bucket_rows=2), "score"))
    assert cut_small == set(pairs(cosine.cosine_pairs(df, 0.97, mode="lsh", bands=24, band_bits=8, bucket_rows=100_000), "score")) == near


def test_cosine_lsh_finds_pairs_at_the_threshold_of_the_query(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    for signs in ({}, {"band_bits": 8}):
        assert cosine.lsh_recall(df, 0.35, features="embedding", id_col="vec_id", **signs) >= 0.9


@pytest.mark.parametrize("n", [2_000, 10**6, 3 * 10**7])
@pytest.mark.parametrize("t", [0.35, 0.85, 0.97, 1.0])
def test_cosine_bands_follow_threshold_and_signs(n, t):
    bands, bits = cosine.banding(n, t, 2_000)
    alike = (1 - np.arccos(t) / np.pi) ** bits
    assert 1 - (1 - alike) ** bands >= 0.98


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


CASES = {
    "empty": [], "self": [(3, 3)], "one": [(2, 1)], "both ways": [(1, 2), (2, 1), (1, 2)],
    "chain": [(i, i + 1) for i in range(20)], "star": [(9, i) for i in range(9)], "two": [(1, 2), (5, 4), (4, 3)],
}


@pytest.mark.parametrize("last_edges", [16_000, 0])
@pytest.mark.parametrize("name", CASES)
def test_groups_of_known_shapes(spark, name, last_edges):
    df = spark.createDataFrame(CASES[name], "id_a bigint, id_b bigint")
    assert {r["id"]: r["group_id"] for r in duplicate_groups(df, last_edges=last_edges).collect()} == components(CASES[name])


@pytest.mark.parametrize("held", [1, 7, 1000])
def test_contraction_keeps_what_is_connected(held):
    rng = random.Random(held)
    edges = [tuple(rng.sample(range(300), 2)) for _ in range(200)]
    batches = [pa.RecordBatch.from_pydict({"u": [max(e) for e in part], "v": [min(e) for e in part]}) for part in (edges[:90], edges[90:91], edges[91:])]
    left = [e for i in range(0, 3, held) for b in [groups._star([(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches[i:i + held]], pa.int64())]
            for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert components(left) == components(edges) and all(u > v for u, v in left)
    assert held < 3 or sorted(left) == sorted((i, g) for i, g in components(edges).items() if i != g)


def test_groups_of_names_nulls_and_a_long_chain(spark, monkeypatch):
    named = spark.createDataFrame([("b", "a"), ("é", "b"), ("x", None), ("z", "y"), ("q", "q")], "id_a string, id_b string")
    assert {r["id"]: r["group_id"] for r in duplicate_groups(named).collect()} == {"a": "a", "b": "a", "é": "a", "y": "y", "z": "y"}
    rounds = []
    write = groups.cut
    monkeypatch.setattr(groups, "cut", lambda df: rounds.append(0) or write(df))
    chain = spark.range(20_000).selectExpr("id AS id_a", "id + 1 AS id_b")
    got = duplicate_groups(chain, last_edges=1_000)
    assert got.count() == 20_001 and got.filter("group_id <> 0").count() == 0
    assert len(rounds) <= 9  # 15 and more without contraction


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_groups_of_any_pairs(spark, edges):
    df = spark.createDataFrame(edges, "id_a bigint, id_b bigint")
    assert {r["id"]: r["group_id"] for r in duplicate_groups(df).collect()} == components(edges)


def test_rounds_are_capped(spark, monkeypatch):
    monkeypatch.setattr(groups, "_contracted", lambda edges, held=None: edges)
    df = spark.range(500).selectExpr("id AS id_a", "id + 1 AS id_b")
    with pytest.raises(RuntimeError):
        duplicate_groups(df, max_rounds=1, last_edges=0)


def test_exact_duplicates_and_best(spark):
    df = spark.createDataFrame([(1, "x", 1), (2, "x", 9), (3, "y", 5), (4, None, 1), (5, None, 2), (6, "x", 9)], "id int, t string, q int")
    found = exact.exact_duplicates(df, "t").collect()
    assert [(r["group_id"], r["n"]) for r in found] == [(1, 3)]
    linked = exact.groups_from_links(exact.copy_links(df, F.col("t")))
    kept = sorted(r["id"] for r in exact.keep_best(df, linked, [-F.col("q")]).collect())
    assert kept == [2, 3, 4, 5]
    assert sorted((r["id"], r["kept_id"]) for r in exact.removals(df, linked, [-F.col("q")]).collect()) == [(1, 2), (6, 2)]


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_partitions_do_not_matter(spark, partitions):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text").repartition(partitions)
    p = jaccard.jaccard_pairs(docs, hs.words(F.col("text")), 0.6)
    h = hamming.hamming_pairs(fingerprints.simhash(docs, hs.words(F.col("text"))), 4, 60)
    got = (pairs(p, "score"), pairs(h, "distance"), sorted(tuple(r) for r in duplicate_groups(p).collect()))
    first = test_partitions_do_not_matter.__dict__.setdefault("first", got)
    assert got == first


def test_vectors_with_nan_or_infinity_pair_with_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, None), (6, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    for all_pairs in (True, False):
        got = cosine.cosine_pairs(df, 0.9, all_pairs=all_pairs).collect()
        assert [(r.id_a, r.id_b) for r in got] == [(1, 2)]


def test_zero_has_one_sign(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [-0.0, 1.0])], "id long, features array<double>")
    assert [(r.id_a, r.id_b, r.score) for r in cosine.cosine_pairs(df, 0.9).collect()] == [(1, 2, 1.0)]


def test_a_cell_is_sent_each_set_once_and_counts_each_token_once():
    pairs = pa.table({"ia": [1, 1, 2], "ib": [2, 3, 3], "cell": [0, 0, 0]})
    sets = pa.table({"of": [0] * 4, "id": [1, 2, 3, 3], "n": [3, 3, 2, 1],
                     "r": pa.array([["a", "b", "c", "c"], ["b", "c", "d", "d"], ["c", None], ["x"]])})
    got = sorted(zip(*jaccard._common_tokens(pairs, sets).to_pydict().values()))
    assert got == [(1, 2, 2, 6), (1, 3, 0, 4), (1, 3, 1, 5), (2, 3, 0, 4), (2, 3, 1, 5)]
    assert jaccard._common_tokens(pairs, sets.slice(0, 0)).num_rows == 0


def test_rows_that_come_twice_score_as_one(spark):
    words = [f"w{i}" for i in range(20)]
    rows = [(1, words), (2, words[:19] + ["x"]), (3, ["y"])]
    df = spark.createDataFrame([*rows, *rows], "id bigint, t array<string>")
    for mode in ("exact", "lsh"):
        got = jaccard.jaccard_pairs(df, F.col("t"), 0.8, mode=mode).distinct().collect()
        assert [(r.id_a, r.id_b, round(r.score, 6)) for r in got if r.id_a != r.id_b] == [(1, 2, round(19 / 21, 6))]


def test_packed_ranks_come_back():
    rng = random.Random(4)
    lists = [sorted(rng.sample(range(1 << most), min(1 << most, rng.randint(1, 40)))) for most in (1, 7, 8, 14, 21, 35, 50, 62) for _ in range(3)]
    lists[5:5] = [[], []]
    lists += [[0], []]
    packed = jaccard._packed(np.array([x for r in lists for x in r], np.int64), np.array([len(r) for r in lists]))
    for strings, want in ((packed, lists), (packed.slice(4, 9), lists[4:13]), (packed.slice(5, 2), [[], []]), (packed.slice(0, 0), [])):
        ranks, lengths = jaccard._unpacked(strings)
        assert [r.tolist() for r in np.split(ranks, np.cumsum(lengths))[:-1]] == want
    assert sum(len(x.as_py()) for x in jaccard._packed(np.arange(1000), np.array([1000]))) == 1000


def test_sets_leave_a_task_whole(spark):
    """One string for each set and task, not one for each token."""
    df = spark.createDataFrame([(i % 30, [f"w{j}" for j in range(i % 30, i % 30 + 9)]) for i in range(60)], "id bigint, s array<string>").coalesce(2)
    rows = jaccard._rows_of_tokens(df).withColumn("rank", F.substring("token", 2, 9).cast("bigint")).select("id", "n", "_row", "rank")
    pieces = rows.mapInArrow(jaccard._strings, "id bigint, n int, piece binary").collect()
    assert sorted((r.id, r.n) for r in pieces) == sorted((i % 30, 9) for i in range(60))


def tables_of(monkeypatch):
    """Tables that the operator writes, by label, as it writes them."""
    seen, real = {}, jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df, label, *a: seen.setdefault(label, real(df, label, *a)))
    return seen


def test_a_crowd_is_sent_to_few_cells(spark, monkeypatch):
    """Near copies that are not all alike have several lowest partners; their sets are not sent once for each of those."""
    rng = random.Random(11)
    template = [f"t{i}" for i in range(40)]
    sets = [(i, set(rng.sample(template, 37))) for i in range(300)]
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in sets], "id bigint, text string")
    seen = tables_of(monkeypatch)
    got = pairs(jaccard.jaccard_pairs(df, hs.words(F.col("text")), 0.86))
    assert got == brute_jaccard(sets, 86) and len(got) > 9_000
    assert seen["cells"].select("cell", F.explode(F.array("ia", "ib"))).distinct().count() < 2 * 300


def test_tables_go_when_they_are_read(spark, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 9, i % 9 + 20))) for i in range(40)], "id bigint, text string")
    seen = tables_of(monkeypatch)
    kept = {}
    real = jaccard.dropped
    monkeypatch.setattr(jaccard, "dropped", lambda *tables: (kept.update({id(t): t.inputFiles() for t in tables}), real(*tables)))
    found = jaccard.jaccard_pairs(df, hs.words(F.col("text")), 0.8)
    assert {label for label, t in seen.items() if id(t) in kept} >= {"sets", "candidates", "met"}
    assert not any(os.path.exists(f.removeprefix("file://")) for files in kept.values() for f in files)
    assert pairs(found) == brute_jaccard([(r.id, set(r.text.split())) for r in df.collect()], 80)


def test_large_buckets_are_paired_in_place(spark, monkeypatch):
    """Pairs are taken in slices of tokens and passed on in lists, whatever their sizes."""
    run = jaccard._pairs_of_tokens(80)
    rng = random.Random(12)
    rows = sorted((t, 20, i) for t in range(6) for i in rng.sample(range(50), 30))
    table = pa.table({"token": [r[0] for r in rows], "n": [20] * len(rows), "id": [r[2] for r in rows], "size": [20] * len(rows), "index": [3] * len(rows),
                      "pos": [0] * len(rows), **{b: [0] * len(rows) for b in jaccard.BITMAP}})
    want = {(a, b) for t in range(6) for a in range(50) for b in range(a + 1, 50) if (t, 20, a) in rows and (t, 20, b) in rows}
    for paired, held in ((10**6, 10**6), (7, 10**6), (40, 5)):
        monkeypatch.setattr(jaccard, "PAIRED_ROWS", paired)
        monkeypatch.setattr(jaccard, "PAIRS_HELD", held)
        got = [(r["ia"], x) for b in run(iter(table.to_batches(max_chunksize=11))) for r in b.to_pylist() for x in r["partners"]]
        assert set(got) == want
