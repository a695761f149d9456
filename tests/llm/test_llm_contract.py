import re

import pytest
from check_sql import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from lumisift.llm import catalog, classify, stages
from lumisift.llm.common import table

SF = "/root/testdata/sf0.001"
MORE = ("id", "n", "key", "rep", "size", "ka", "kb", "wanted", "spans", "host", "path", "kind", "good", "_raw", "_spans", "c0", "c1")


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    result = compare(spark, connect(SF), SF, name, catalog.QUERIES[name], catalog.SQL.get(name))
    assert result.startswith("ok" if name in catalog.SQL else "rows="), result


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "repeated_passages", "benchmark_passages", "source_mix"]


def test_pipeline_runs_its_stages_in_order(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if stage is not stages.source_mix:
            assert docs.columns == before.columns and dict(docs.dtypes) == dict(before.dtypes)
    rows = got.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, docs.collect()))
    assert 0 < len(rows) < table(spark, SF, "documents").count()
    # The mix has the texts themselves, and how often each is in it.
    assert all(r.times >= 1 and r.taken == r.times * r.size == r.times * len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)


def test_verdicts_are_by_row(spark):
    """Poor rows without an id, or under the id of a clean one, go; the clean one stays."""
    labels = table(spark, SF, "labels")
    docs = table(spark, SF, "documents")
    known = sorted((r.own, r.doc_id) for r in classify.quality(docs, labels).collect())
    poor, clean = (docs.filter(F.col("doc_id") == known[at][1]) for at in (0, -1))  # by their words alone, as no label goes with them
    nameless = poor.withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat("text", F.lit(" ")))
    shared = poor.withColumn("doc_id", F.lit(clean.first().doc_id).cast("long")).withColumn("text", F.concat("text", F.lit("  ")))
    rows = docs.unionByName(nameless).unionByName(shared)
    verdicts = {(r.doc_id, r.text): r.kept for r in
                classify.quality(rows, labels, row=[F.xxhash64("text")]).join(rows.select("text", F.xxhash64("text").alias("row_0")).distinct(), "row_0").collect()}
    kept = {(r.doc_id, r.text) for r in stages.quality_classifier(spark, rows, SF).collect()}
    assert kept == {key for key, keep in verdicts.items() if keep}
    assert (clean.first().doc_id, clean.first().text) in kept
    assert (None, nameless.first().text) not in kept


def test_near_copies_under_shared_ids(spark, make):
    texts = [" ".join(f"t{d}w{i}" for i in range(80)) for d in range(4)]
    rows = [(1, texts[0]), (2, texts[1]), (2, texts[2]), (2, texts[2]), (3, texts[1] + " end"), (None, texts[3]), (None, texts[0]), (4, None), (4, "")]
    kept = sorted(map(str, ((r.doc_id, (r.text or "")[:4]) for r in stages.near_duplicates(spark, make(rows, extra=False), SF).collect())))
    # Texts 0 and 1 are kept under the ids that are theirs alone; 2 and 3 have no other copy.
    assert kept == sorted(map(str, [(1, "t0w0"), (2, "t2w0"), (3, "t1w0"), (None, "t3w0"), (4, ""), (4, "")]))


def test_every_stage_on_messy_and_empty_tables(spark, make, messy):
    docs = make(messy, extra=False)
    wide = docs.selectExpr("*", *[f"doc_id AS `{c}`" for c in MORE])
    for rows in (docs, wide, wide.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            assert out.count() <= rows.count()
            if stage is not stages.source_mix:
                assert out.columns == rows.columns


def test_decisions_take_effect(spark, make):
    item = table(spark, SF, "benchmark").first().text
    passage = " ".join(f"passage{i}" for i in range(60))
    body = [" ".join(f"doc{d}word{i}" for i in range(120)) for d in range(6)]
    rows = [(0, body[0]), (1, body[0] + " tail"), (2, body[2] + " " + passage), (3, passage + " " + body[3]), (4, body[4] + " " + item), (5, body[5])]
    docs = make(rows, extra=False)
    near = stages.near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in near.collect()) == [0, 2, 3, 4, 5]
    cut = {r.doc_id: r for r in stages.repeated_passages(spark, near, SF).collect()}
    assert "passage30" not in cut[2].text + cut[3].text and body[2][:-1] in cut[2].text and cut[0].text == body[0] and cut[2].n_chars == len(cut[2].text)
    clean = {r.doc_id: r.text for r in stages.benchmark_passages(spark, near, SF).collect()}
    assert len(clean) == 5 and item[:40] not in clean[4] and clean[4].startswith(body[4]) and clean[5] == body[5]
    labels = table(spark, SF, "labels")
    kinds = classify.kinds(labels, "doc_id")
    kept = {r.doc_id for r in stages.quality_classifier(spark, table(spark, SF, "documents"), SF).collect()}
    good = [r.id in kept for r in kinds.collect() if r.kind == classify.GOOD]
    assert sum(good) / len(good) > 0.9
