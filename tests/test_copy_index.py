import random
import re

import pytest
from pyspark.sql import functions as F
from test_multi_index import near_copies

from lumisift.operators.groups import duplicate_groups
from lumisift.operators.multi_index import hamming_pairs_far
from lumisift.sources import copy_index
from lumisift.sources.copy_index import CopyIndex, displaced


def brute(values, k):
    """Groups by union of all pairs."""
    parent = {i: i for i, _ in values}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, h) in enumerate(values):
        for j, g in values[n + 1:]:
            if ((h ^ g) & (1 << 64) - 1).bit_count() <= k:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    groups = {i: find(i) for i in parent}
    sizes = {}
    for g in groups.values():
        sizes[g] = sizes.get(g, 0) + 1
    return {i: g for i, g in groups.items() if sizes[g] > 1}


def frame(spark, values):
    return spark.createDataFrame([*values, (None, 5), (10**6, None)], "id bigint, hash bigint")


def groups(index):
    rows = index.groups().collect()
    assert len(rows) == len({r["id"] for r in rows})
    return {r["id"]: r["group_id"] for r in rows}


@pytest.mark.parametrize("k", [0, 6])
def test_groups_after_loads_are_those_of_all_rows(spark, tmp_path, k):
    rng = random.Random(k)
    values = near_copies(rng, 150, 64, 5) + [(i, rng.getrandbits(62)) for i in range(150, 180)]
    rng.shuffle(values)  # ids that arrive later are often lower, so groups get other names
    index = CopyIndex.create(spark, str(tmp_path / "index"), k, buckets=4)
    before = {}
    for begin in range(0, 180, 60):
        changes = index.add(frame(spark, values[begin:begin + 60]))
        now = brute(values[:begin + 60], k)
        assert groups(index) == now
        want = {(i, g, before.get(i)) for i, g in now.items() if before.get(i) != g}
        assert {tuple(r) for r in changes.select("id", "group_id", "was").collect()} == want
        before = now
    again = CopyIndex(spark, str(tmp_path / "index"))  # settings and tables are read from the folder
    again.compact()
    assert groups(again) == before
    again.add(frame(spark, [(-1, values[0][1])]))
    assert groups(again) == brute([*values, (-1, values[0][1])], k)
    assert again.entries().select("h").distinct().count() == len({h for _, h in values})


def test_a_load_that_failed_is_not_seen(spark, tmp_path, monkeypatch):
    index = CopyIndex.create(spark, str(tmp_path / "index"), 2, buckets=2)
    index.add(frame(spark, [(1, 0), (2, 1)]))
    monkeypatch.setattr(CopyIndex, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.add(frame(spark, [(3, 3), (4, 0xFFFF << 30)]))
    monkeypatch.undo()
    assert groups(index) == {1: 1, 2: 1}
    index.add(frame(spark, [(3, 3), (4, 0xFFFF << 30)]))
    assert groups(index) == {1: 1, 2: 1, 3: 1}


def test_an_empty_load_and_an_empty_index(spark, tmp_path):
    index = CopyIndex.create(spark, str(tmp_path / "index"), 2, buckets=2)
    assert groups(index) == {} and index.add(frame(spark, [])).count() == 0
    assert index.add(frame(spark, [(1, 7)])).count() == 0 and groups(index) == {}


def test_the_stored_side_is_not_shuffled(spark, tmp_path):
    index = CopyIndex.create(spark, str(tmp_path / "index"), 6, buckets=4)
    index.add(frame(spark, near_copies(random.Random(1), 100, 64, 5)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = index.near_stored(spark.createDataFrame([(1 << 20, 5)], "id bigint, h bigint"))
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One shuffle, of the look-ups, to as many partitions as there are buckets; a bucketed scan of the table without any.
    assert "SortMergeJoin" in plan and len(re.findall(r"Exchange hashpartitioning\(key#\d+L, 4\)", plan)) == plan.count("Exchange") == 1
    stored = plan[:plan.index("Exchange")]
    assert "SelectedBucketsCount: 4 out of 4" in stored or re.search(r"FileScan parquet .*Bucketed: true", stored)


def test_crowded_stored_substrings_are_cut_again(spark, tmp_path):
    rng = random.Random(9)
    values = [(i, rng.getrandbits(20) | 5 << 50) for i in range(400)]
    index = CopyIndex.create(spark, str(tmp_path / "index"), 6, buckets=4)
    index.add(frame(spark, values[:300]))
    distinct = spark.createDataFrame(values[300:], "id bigint, h bigint")
    plain, deep = ({tuple(r) for r in index.near_stored(distinct, bucket_rows=n).collect()} for n in (10**6, 20))
    want = {(i, j, (h ^ g).bit_count()) for i, h in values[:300] for j, g in values[300:] if (h ^ g).bit_count() <= 6}
    assert plain == deep == want


def test_copies_cost_one_member_each(spark, tmp_path):
    index = CopyIndex.create(spark, str(tmp_path / "index"), 3, buckets=2)
    index.add(spark.range(2000).select("id", F.lit(7).cast("long").alias("hash")))
    index.add(spark.range(2000, 4000).select("id", F.lit(7).cast("long").alias("hash")))
    assert index.entries().select("id").distinct().count() == 1 and set(groups(index).values()) == {0} and len(groups(index)) == 4000


def test_best_member_of_changed_groups(spark, tmp_path):
    index = CopyIndex.create(spark, str(tmp_path / "index"), 0, buckets=2)
    index.add(frame(spark, [(1, 5), (2, 5), (3, 9), (4, 9)]))
    changes = index.add(frame(spark, [(5, 5), (6, 5)]))
    scores = spark.createDataFrame([(1, 3.0), (2, None), (5, 1.0), (6, 1.0)], "id bigint, score double")
    got = {tuple(r) for r in displaced(index.groups(), changes, scores).collect()}
    assert got == {(1, 1, 5), (2, 1, 5), (6, 1, 5)}  # the group of 3 and 4 was left alone


def test_index_agrees_with_one_join(spark, tmp_path):
    values = near_copies(random.Random(3), 120, 60, 4)
    index = CopyIndex.create(spark, str(tmp_path / "index"), 8, 60, buckets=3)
    for part in (values[::2], values[1::2]):
        index.add(frame(spark, part))
    at_once = duplicate_groups(hamming_pairs_far(frame(spark, values), 8, 60))
    assert groups(index) == {r["id"]: r["group_id"] for r in at_once.collect()}


def test_a_crowd_is_not_written_pair_by_pair(spark, tmp_path, monkeypatch):
    """Some 40,000 pairs of 800 hashes are within the distance; what a load writes grows with the hashes."""
    hashes = [0, *(1 << i for i in range(40)), *(1 << i | 1 << j for i in range(40) for j in range(i))][:800]
    random.Random(4).shuffle(hashes)
    values, written, cut = list(enumerate(hashes)), {}, copy_index.cut

    def counted(df, label="table"):
        out = cut(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(copy_index, "cut", counted)
    index = CopyIndex.create(spark, str(tmp_path / "index"), 3, 60, buckets=4)
    for part in (values[:400], values[400:]):
        index.add(frame(spark, part))
    pairs = sum((h ^ g).bit_count() <= 3 for i, h in enumerate(hashes) for g in hashes[:i])
    assert groups(index) == brute(values, 3) and pairs > 30_000
    assert max(written.values()) < 10 * len(values)


def test_stored_hashes_that_come_again_are_not_looked_up(spark, tmp_path, monkeypatch):
    values = near_copies(random.Random(8), 60, 60, 3)
    index = CopyIndex.create(spark, str(tmp_path / "index"), 3, 60, buckets=2)
    index.add(frame(spark, values))
    asked, near_stored = [], CopyIndex.near_stored
    monkeypatch.setattr(CopyIndex, "near_stored", lambda self, distinct, at: asked.append(distinct.count()) or near_stored(self, distinct, at))
    again = [(i - 100, h) for i, h in values] + [(500, values[0][1] ^ 3), (501, values[1][1])]
    changes = index.add(frame(spark, again))
    now, before = brute([*values, *again], 3), brute(values, 3)
    assert asked == [len({h for _, h in again} - {h for _, h in values})] and groups(index) == now
    assert {tuple(r) for r in changes.select("id", "group_id", "was").collect()} == {(i, g, before.get(i)) for i, g in now.items() if before.get(i) != g}
