import random
from math import comb

import pytest
from pyspark.sql import functions as F
from test_duplicates import brute_hamming, pairs

from lumisift.operators import multi_index as mi


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def near_copies(rng, n, bits, most):
    centres = [rng.getrandbits(bits) for _ in range(10)]
    out = []
    for i in range(n):
        h = rng.choice(centres)
        for _ in range(rng.randint(0, most)):
            h ^= 1 << rng.randrange(bits)
        out.append((i, signed(h)))
    return out


@pytest.mark.parametrize("k, bits, parts, bucket_rows", [
    (10, 64, None, 2000), (10, 64, 4, 3), (7, 60, 3, 1), (16, 64, 7, 10), (12, 64, 13, 2), (2, 64, None, 2000), (5, 8, None, 2000), (0, 64, None, 1)])
def test_equals_brute_force(spark, k, bits, parts, bucket_rows):
    values = near_copies(random.Random(k), 200, bits, k)
    values += [(1000 + i, h) for i, h in values[:20]]
    df = spark.createDataFrame(values + [(999, None)], "id bigint, hash bigint").repartition(3)
    got = mi.hamming_pairs_far(df, k, bits, bucket_rows=bucket_rows, substrings=parts)
    assert pairs(got, "distance") == brute_hamming(values, k)


def test_crowded_substrings_stay_exact(spark):
    """A third of all hashes agree on the first 44 bits, hence on two of four substrings, and all of theirs meet there."""
    rng = random.Random(5)
    values = [(i, rng.getrandbits(16) if i % 3 == 0 else signed(rng.getrandbits(64))) for i in range(900)]
    df = spark.createDataFrame(values, "id bigint, hash bigint")
    got = mi.hamming_pairs_far(df, 10, 64, bucket_rows=20, substrings=4)
    assert pairs(got, "distance") == brute_hamming(values, 10)


def test_crowded_keys_are_not_joined_as_they_are(spark):
    """With the cut, far fewer pairs are compared than the crowd has."""
    rng = random.Random(6)
    df = spark.createDataFrame([(i, signed(rng.getrandbits(32))) for i in range(4000)], "id bigint, hash bigint")
    compared = {}
    joined = mi.joined

    def counted(entries, probes, keys, conditions, distance):
        n = entries.groupBy(*keys).count().join(probes.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), keys).agg(F.sum(F.col("count") * F.col("m"))).first()[0]
        compared[bucket_rows] = compared.get(bucket_rows, 0) + (n or 0)
        return joined(entries, probes, keys, conditions, distance)

    mi.joined = counted
    try:
        for bucket_rows in (10**9, 500):
            mi.hamming_pairs_far(df, 4, 64, bucket_rows=bucket_rows, substrings=2)
    finally:
        mi.joined = joined
    assert compared[500] < compared[10**9] / 10


@pytest.mark.parametrize("k", range(1, 25))
@pytest.mark.parametrize("parts", [1, 2, 3, 4, 7, 10])
def test_radii_cover_every_split_of_the_distance(k, parts):
    r = mi.radii(k, parts)
    assert sum(x + 1 for x in r) == k + 1  # so no way to place k differences beats all radii


def test_rows_sent_are_bounded_and_as_stated():
    assert mi.rows_sent(64, 10, 4) == 3 * (1 + sum(comb(16, i) for i in range(3))) + 1 + 17
    for rows in (10**3, 10**6, 10**9, 10**12):
        for k in range(1, 21):
            parts = mi.choose_parts(rows, 64, k)
            assert mi.rows_sent(64, k, parts) <= mi.MOST_ROWS
    # More hashes are met with longer substrings.
    assert [mi.choose_parts(n, 64, 10) for n in (10**4, 10**6, 10**8)] == sorted((mi.choose_parts(n, 64, 10) for n in (10**4, 10**6, 10**8)), reverse=True)
    assert mi.choose_parts(10**8, 64, 10) < mi.choose_parts(10**4, 64, 10)


@pytest.mark.parametrize("far", [False, True])
def test_exploded_keys_are_never_broadcast(spark, far, monkeypatch):
    """Spark takes exploded rows to be as small as their table, so it would send them all to the driver."""
    from lumisift.operators import hamming

    rng = random.Random(3)
    hashes = spark.createDataFrame([(i, rng.getrandbits(60)) for i in range(300)], "id long, h long")
    seen = []
    if far:
        cuts, within = mi.cut_bits(60, 5), mi.radii(10, 5)
        seen = [mi.joined(mi.listed_rows(hashes, cuts, within), mi.asked_rows(hashes, cuts, within), ["c0", "v0"], ["ia < ib"], 10)]
    else:
        join = hamming._join
        monkeypatch.setattr(hamming, "_join", lambda *a: seen.append(join(*a)) or seen[-1])
        hamming.hamming_pairs(hashes.withColumnRenamed("h", "hash"), 3, 60)
    plans = [found._jdf.queryExecution().executedPlan().toString() for found in seen]
    assert plans and all("Generate" in p and "SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_close_hashes_meet_in_blocks(spark, monkeypatch):
    """Where most hashes share most substrings, no row is sent to be looked up, and every block meets every block."""
    monkeypatch.setattr(mi, "SMALL_BLOCK", 40)
    monkeypatch.setattr(mi, "AT_ONCE", 100)
    monkeypatch.setattr(mi, "PAIRS_SENT", 50)
    monkeypatch.setattr(mi, "look_up", None)
    rng = random.Random(8)
    values = [(i, signed(rng.getrandbits(20) | 1 << 63)) for i in range(300)]
    values += [(1000 + i, h) for i, h in values[:20]]
    df = spark.createDataFrame([*values, (999, None), (None, 5)], "id bigint, hash bigint").repartition(3)
    found = mi.hamming_pairs_far(df, 5, 64)
    assert pairs(found, "distance") == brute_hamming(values, 5)
    named = mi.hamming_pairs_far(df.withColumn("id", F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 5, "0"))), 5, 64)
    assert sorted((int(a[1:]), int(b[1:]), d) for a, b, d in named.collect()) == sorted(tuple(r) for r in found.collect())


def test_spread_hashes_are_looked_up(spark, monkeypatch):
    rng = random.Random(9)
    df = spark.createDataFrame([(signed(rng.getrandbits(64)), i) for i in range(20_000)], "h bigint, id bigint")
    assert not mi.blocks_are_cheaper(df, 64, 3)
    assert mi.blocks_are_cheaper(df.withColumn("h", F.expr("h & 1048575")), 64, 10)
