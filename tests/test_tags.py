import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumisift.functions import tags as tg
from lumisift.operators import select, tags

RAW = "small_ring economy_(type)  size_11 brand#2"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("comma, underscore, escape, want", [
    (True, True, True, "small ring, economy \\(type\\), size 11, brand#2"),
    (True, False, False, "small_ring, economy_(type), size_11, brand#2"),
    (False, False, True, "small_ring economy_\\(type\\) size_11 brand#2"),
    (False, True, False, "small ring economy (type) size 11 brand#2"),
])
def test_format(spark, comma, underscore, escape, want):
    assert one(spark, tg.format_caption(F.col("raw"), comma, underscore, escape), raw=RAW) == want


@pytest.mark.parametrize("caption, want", [
    ("a, b ,, a", ["a", "b", "a"]), ("", []), ("  \n ", []), (None, None),
    ("economy \\(type\\), x  y", ["economy (type)", "x y"]), ("bare (x)", ["bare (x)"]),
])
def test_parse(spark, caption, want):
    assert one(spark, tg.parse_caption(F.col("caption")), caption=caption) == want


def test_parse_refuses_lost_boundaries(spark):
    df = spark.createDataFrame([(1, "a b")], "id int, caption string")
    with pytest.raises(ValueError):
        tags.parse_tags(df, comma_separated=False)


word = st.text(alphabet="abz_()#19", min_size=1, max_size=8).filter(lambda w: w.strip("_") == w)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(word, max_size=6), min_size=1, max_size=20))
def test_parse_undoes_format(spark, rows):
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "id int, raw string")
    got = tags.parse_tags(tags.format_tags(df)).collect()
    for row in got:
        assert row["tags"] == [" ".join(w.replace("_", " ").split()) for w in rows[row["id"]]]


def test_literal_edit_and_edit_table_agree(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["c", "x"])], "id int, tags array<string>")
    edits = spark.createDataFrame([("remove", "b", None), ("replace", "a", "c"), ("replace", "c", "d"), ("add", "new", None)],
                                  "op string, tag string, new_tag string")
    table = {r["id"]: r["tags"] for r in tags.edit_tags(df, edits).collect()}
    literal = df.select("id", tg.edit_tag_array(F.col("tags"), ["b"], {"a": "c", "c": "d"}, ["new"], dedupe=True).alias("tags"))
    assert table == {r["id"]: r["tags"] for r in literal.collect()}
    assert table == {1: ["c", "new"], 2: ["new"], 3: ["new"], 4: ["d", "x", "new"]}  # one pass: a becomes c, not d


def test_edit_keeps_every_row_on_both_paths(spark):
    df = spark.createDataFrame([(None, ["a"]), (1, ["a", None, "b"]), (1, ["c"]), (2, None)], "id int, tags array<string>")
    edits = spark.createDataFrame([("replace", "a", "x"), ("remove", "b", None), ("add", "z", None)], "op string, tag string, new_tag string")
    for most in (256, 0):
        got = sorted([(r["id"], tuple(r["tags"])) for r in tags.edit_tags(df, edits, most_literal=most).collect()], key=str)
        assert got == sorted([(None, ("x", "z")), (1, ("x", "z")), (1, ("c", "z")), (2, ("z",))], key=str)
    with pytest.raises(ValueError, match="two replacements"):
        tags.edit_tags(df, edits.unionByName(spark.createDataFrame([("replace", "a", "y")], edits.schema.simpleString()[7:-1].replace(":", " "))))


def test_edit_table_keeps_other_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "p", ["a", "a"])], "id int, path string, tags array<string>")
    edits = spark.createDataFrame([("remove", "z", None)], "op string, tag string, new_tag string")
    assert tags.edit_tags(df, edits, dedupe=False).first().asDict() == {"id": 1, "path": "p", "tags": ["a", "a"]}


def test_tag_counts(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a"]), (3, []), (4, None)], "id int, tags array<string>")
    assert {(r["tag"], r["images"], r["share"]) for r in tags.tag_counts(df).collect()} == {("a", 2, 0.5), ("b", 1, 0.25)}


@pytest.mark.parametrize("path, regex, want", [
    ("/x/my cat-01.png", "", ["my cat-01"]), ("/x/my cat-01.png", "[a-z]+", ["my", "cat"]), (".hidden", "", [".hidden"]),
    ("/x/a.b.jpg", "", ["a.b"]), ("/x/", "", []),
])
def test_filename_tags(spark, path, regex, want):
    assert one(spark, tg.words_of_stem(F.col("path"), regex), path=path) == want


def test_selection_forms_agree(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, None), (4, ["c"]), (5, ["A", "b"])], "id int, tags array<string>")
    rows = tags.explode_tags(df)
    for all_of in ([], ["a"], ["a", "b"]):
        for any_of in ([], ["b", "c"]):
            for none_of in ([], ["c"]):
                x = {r["id"] for r in select.select_by_tags(df, all_of, any_of, none_of).collect()}
                y = {r["id"] for r in select.select_by_tag_rows(df, rows, all_of, any_of, none_of).collect()}
                assert x == y
    assert {r["id"] for r in select.select_by_tags(df, any_of=["b"]).collect()} == {1, 5}


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_batches(spark, partitions):
    df = spark.range(250).select("id", (F.col("id") % 7).alias("k")).repartition(partitions)
    got = select.assign_batches(df, 60, ["k", "id"]).orderBy("k", "id").collect()
    assert [r["batch"] for r in got] == [i // 60 for i in range(250)]
    with pytest.raises(ValueError):
        select.assign_batches(df, 101)


def test_take_n_beyond_one_task(spark, monkeypatch):
    df = spark.range(1000).repartition(5)
    want = [r["id"] for r in select.take_n(df, 300).orderBy("id").collect()]
    monkeypatch.setattr(select, "SMALL_N", 10)
    assert [r["id"] for r in select.take_n(df, 300).orderBy("id").collect()] == want == list(range(300))
    assert select.take_n(df, 0).count() == 0
