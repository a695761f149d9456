import math
import re
from collections import Counter

from pyspark.sql import functions as F

from lumisift.llm import classify, rules
from lumisift.llm.common import table

SF = "/root/testdata/sf0.01"


def labels_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kinds = classify.kinds(labels, "doc_id")
    learnt, rest = kinds.filter("id % 3 <> 0"), kinds.filter("id % 3 = 0")
    evidence = classify.fit(docs.selectExpr("doc_id AS id", "text"), learnt)
    got = classify.quality(docs, labels.limit(0), evidence=evidence).join(rest, F.col("doc_id") == F.col("id")).collect()
    good = [r.kept for r in got if r.kind == classify.GOOD]
    bad = [not r.kept for r in got if r.kind != classify.GOOD]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) > 0.75


def test_sites_of_few_documents_shrink(spark, make):
    # One site where half of the labelled texts are poor, and one with a single poor text.
    rows = [(i, f"text {i}", "big" if i < 200 else "fair" if i < 399 else "single") for i in range(400)]
    labels = labels_frame(spark, [(i, int(i % 2 == 0 if i < 200 else i < 399), 0) for i in range(400)])
    plain = classify.Evidence(*([classify.np.zeros(0)] * 3), classify.np.array([-2.0] + [0] * 7))
    got = {r.doc_id: r for r in classify.quality(make(rows, extra=False), labels, evidence=plain).collect()}
    assert got[0].site < 0.6 < got[300].site and 0.5 < got[399].site < 0.9


def test_classifier_on_messy_and_empty(spark, make, messy):
    labels = labels_frame(spark, [(1, 1, 0), (1, 0, 1), (None, 0, 0), (5, None, None), (7, 1, None), (99, 0, 0)])
    got = classify.quality(make(messy, extra=False).drop("host"), labels).collect()
    assert len(got) == len(messy) and all(0 <= r.score <= 1 and r.kept is not None for r in got)
    renamed = make(messy).withColumnRenamed("host", "h").withColumnRenamed("path", "p")
    assert classify.quality(renamed, labels).count() == len(messy)
    assert classify.quality(make([]), labels_frame(spark, [])).count() == 0
    assert all(r.kept for r in classify.quality(make(messy), labels_frame(spark, [])).collect())


def base(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed)


def test_rules_against_brute_force(spark, make, messy):
    texts = [r.text for r in table(spark, SF, "documents").limit(150).collect()]
    texts += ["a b c a b c", "x " * 60, "one\n\none\n one\none", "p q r s " * 3 + "t u v " * 2, "#*$%&|<> é\n\n" * 3]
    rows = messy + [(100 + i, t) for i, t in enumerate(texts)]
    labels = labels_frame(spark, [(r[0], 1, 0) for r in rows if r[0] and r[0] > 100] + [(None, 1, 0)])
    got = rules.quality_rules(make(rows), labels).collect()
    shown = sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], key=str)
    assert shown == sorted([(d, *base(t)) for d, t in rows], key=str)
    assert all(not r.kept for r in got if r.base_failed) and any(r.kept for r in got)
    assert rules.quality_rules(make([]), labels).count() == 0


def test_ratio_is_that_of_the_bucket_counts(spark, make):
    rows = [(1, "good words here " * 20), (2, "bad | stuff " * 20), (3, "good bad " * 30)]
    labels = labels_frame(spark, [(1, 1, 0), (2, 0, 0), (3, 1, 1)])
    hashed = make(rows, extra=False).select("doc_id", rules._hashes(rules.words(F.col("text"))).alias("h1"))
    hashed = hashed.withColumn("h2", rules._next(F.col("h1"), F.col("h1"), 1)).select("doc_id", rules._buckets().alias("b"))
    buckets = {r.doc_id: r.b for r in hashed.collect()}
    raw, target = Counter(sum(buckets.values(), [])), Counter(buckets[1])
    scale = sum(target.values()) / sum(raw.values())
    for r in rules.quality_rules(make(rows), labels).collect():
        b = buckets[r.doc_id]
        want = sum(math.log((target[x] + rules.ADDED) / (raw[x] * scale + rules.ADDED)) for x in b) / len(b)
        assert abs(r.ratio - want) < 2e-6


def test_rules_count_all_trusted_documents(spark, monkeypatch):
    n = 200_300
    docs = spark.range(n).selectExpr("id AS doc_id", "'a b' AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    seen, weights = [], rules.weights
    monkeypatch.setattr(rules, "weights", lambda plain, trusted: seen.append(trusted.count()) or weights(plain, trusted))
    rules.quality_rules(docs, labels)
    assert seen == [n]


def test_rules_weights_are_the_same_past_a_broadcast(spark, make, monkeypatch, messy):
    rows = [*messy, (10, "good words here " * 20), (10, "more words " * 20), (11, "bad | stuff " * 20)]
    labels = labels_frame(spark, [(1, 1, 0), (10, 1, 0), (11, 0, 0)])
    sent = sorted(map(tuple, rules.quality_rules(make(rows, extra=False), labels).collect()), key=str)
    monkeypatch.setattr(rules, "few", lambda ids: ids.hint("merge"))
    assert sorted(map(tuple, rules.quality_rules(make(rows, extra=False), labels).collect()), key=str) == sent


def test_rules_tell_junk_from_good_texts(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kinds = classify.kinds(labels, "doc_id")
    learnt = labels.filter("doc_id % 3 <> 0")
    got = rules.quality_rules(docs, learnt).filter("NOT base_failed").join(kinds.filter("id % 3 = 0"), F.col("doc_id") == F.col("id")).collect()
    good = [r.kept for r in got if r.kind == classify.GOOD]
    assert sum(good) / len(good) > 0.95


def test_rules_run_no_python(spark, make):
    plan = rules.quality_rules(make([(1, "a b")], extra=False), labels_frame(spark, [(1, 1, 0)]), bucket_weights=[0] * rules.BUCKETS)
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in shown and "Arrow" not in shown and "Pandas" not in shown
