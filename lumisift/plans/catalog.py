"""Every operator as a query over the standard tables, with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.functions import hashing as hs
from lumisift.operators import (batch, clusters, cosine, exact, features, fingerprints, groups, hamming, index, jaccard,
                                multi_index, quality, select, tags)
from lumisift.plans import curation
from lumisift.session import cut, fresh_dir, ship
from lumisift.sources import archives, captions, copy_index, files, image_info, tables
from lumisift.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# ---- shared inputs ---------------------------------------------------------

def caption_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat_ws(" ", F.replace("p_name", F.lit(" "), F.lit("_")), F.concat(F.lower("p_type"), F.lit("_(type)")),
                      F.concat(F.lit("size_"), F.col("p_size").cast("string")), F.lower("p_brand"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw"))


CAPTIONS = """captions AS (
  SELECT p_partkey AS id, concat_ws(' ', replace(p_name, ' ', '_'), concat(lower(p_type), '_(type)'),
         concat('size_', p_size), lower(p_brand)) AS raw FROM part)"""
TAGGED = CAPTIONS + """, tagged AS (
  SELECT id, list_transform(string_split(raw, ' '), lambda t: replace(t, '_', ' ')) AS tags FROM captions)"""


def tagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.parse_tags(tags.format_tags(caption_rows(spark, sf_dir))).select("id", "tags")


def joined(col: str) -> Column:
    return F.array_join(col, "|")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), *columns)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("features"))


# ---- tags ------------------------------------------------------------------

@query("format_tags", f"""
WITH {CAPTIONS}
SELECT id, replace(replace(replace(replace(raw, ' ', ', '), '_', ' '), '(', '\\('), ')', '\\)') AS caption FROM captions""")
def format_tags(spark, sf_dir):
    return tags.format_tags(caption_rows(spark, sf_dir)).select("id", "caption")


@query("parse_tags", f"""
WITH {TAGGED} SELECT id, len(tags) AS n_tags, array_to_string(tags, '|') AS tags FROM tagged""")
def parse_tags(spark, sf_dir):
    return tagged_rows(spark, sf_dir).select("id", F.size("tags").cast("bigint").alias("n_tags"), joined("tags").alias("tags"))


DOCUMENT_TAGS = """document_tags AS (
  SELECT doc_id AS id, list_filter(list_transform(string_split(
           replace(replace(regexp_replace(text, '\\s+', ' ', 'g'), '\\(', '('), '\\)', ')'), ','),
           lambda t: trim(t)), lambda t: t <> '') AS tags FROM documents)"""


@query("parse_tags_documents", f"""
WITH {DOCUMENT_TAGS} SELECT id, len(tags) AS n_tags, array_to_string(tags, '|') AS tags FROM document_tags""")
def parse_tags_documents(spark, sf_dir):
    parsed = tags.parse_tags(documents(spark, sf_dir, "text"), "text")
    return parsed.select("id", F.size("tags").cast("bigint").alias("n_tags"), joined("tags").alias("tags"))


@query("explode_tags", f"""
WITH {TAGGED} SELECT id, unnest(range(len(tags))) AS pos, unnest(tags) AS tag FROM tagged""")
def explode_tags(spark, sf_dir):
    return tags.explode_tags(tagged_rows(spark, sf_dir)).withColumn("pos", F.col("pos").cast("bigint"))


@query("tag_counts", f"""
WITH {DOCUMENT_TAGS}, long AS (SELECT id, unnest(list_distinct(tags)) AS tag FROM document_tags)
SELECT tag, count(*) AS images, count(*) / (SELECT count(*) FROM documents)::DOUBLE AS share FROM long GROUP BY tag""")
def tag_counts(spark, sf_dir):
    return tags.tag_counts(tags.parse_tags(documents(spark, sf_dir, "text"), "text"))


@query("edit_tags", f"""
WITH {TAGGED}, kept AS (
  SELECT id, list_transform(list_filter(tags, lambda t: t NOT IN ('size 1', 'size 2', 'size 3', 'size 4')),
           lambda t: CASE WHEN starts_with(t, 'brand#') THEN replace(t, 'brand#', 'maker ') ELSE t END) AS tags FROM tagged)
SELECT id, array_to_string(list_sort(list_distinct(list_append(tags, 'curated'))), '|') AS tags FROM kept""")
def edit_tags(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    small = part.filter("p_size < 5").select(F.lit("remove").alias("op"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("tag"),
                                             none.alias("new_tag")).distinct()
    renamed = part.select(F.lit("replace").alias("op"), F.lower("p_brand").alias("tag"),
                          F.replace(F.lower("p_brand"), F.lit("brand#"), F.lit("maker ")).alias("new_tag")).distinct()
    added = part.select(F.lit("add").alias("op"), F.lit("curated").alias("tag"), none.alias("new_tag")).distinct()
    edited = tags.edit_tags(tagged_rows(spark, sf_dir), small.unionByName(renamed).unionByName(added), sort=True)
    return edited.select("id", joined("tags").alias("tags"))


@query("filename_tags", """
WITH named AS (
  SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '^(.+)\\.[^.]*$', '\\1') AS stem FROM pages)
SELECT page_id, array_to_string(regexp_extract_all(stem, '[A-Za-z]+'), '|') AS tags FROM named""")
def filename_tags(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return tags.filename_tags(pages, "[A-Za-z]+", "url").select("page_id", joined("tags").alias("tags"))


# ---- selection and index ---------------------------------------------------

ALL_OF, ANY_OF, NONE_OF = ["small (type)"], ["brand#1", "brand#2", "brand#3", "size 7"], ["size 11", "red bolt"]
SELECTED = f"""
WITH {TAGGED}
SELECT id FROM tagged WHERE list_contains(tags, 'small (type)')
  AND list_has_any(tags, ['brand#1', 'brand#2', 'brand#3', 'size 7'])
  AND NOT list_has_any(tags, ['size 11', 'red bolt'])"""


@query("select_by_tags", SELECTED)
def select_by_tags(spark, sf_dir):
    return select.select_by_tags(tagged_rows(spark, sf_dir), ALL_OF, ANY_OF, NONE_OF).select("id")


@query("select_by_tag_rows", SELECTED)
def select_by_tag_rows(spark, sf_dir):
    tagged = tagged_rows(spark, sf_dir)
    return select.select_by_tag_rows(tagged.select("id"), tags.explode_tags(tagged), ALL_OF, ANY_OF, NONE_OF)


@query("take_n", f"WITH {CAPTIONS} SELECT id, raw FROM captions ORDER BY raw, id LIMIT 100")
def take_n(spark, sf_dir):
    return select.take_n(caption_rows(spark, sf_dir), 100, ["raw", "id"])


@query("assign_batches", f"""
WITH {CAPTIONS}
SELECT id, (row_number() OVER (ORDER BY raw, id) - 1) // 64 AS batch FROM captions""")
def assign_batches(spark, sf_dir):
    return select.assign_batches(caption_rows(spark, sf_dir), 64, ["raw", "id"]).select("id", "batch")


@query("update_index", """
WITH scan AS (SELECT concat('documents/', doc_id) AS path, n_chars AS length, n_chars AS mtime FROM documents),
prior AS (
  SELECT concat('documents/', doc_id) AS path, n_chars AS length, n_chars + toxic AS mtime
  FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT concat('benchmark/', item_id), length(text), length(text) FROM benchmark)
SELECT coalesce(s.path, p.path) AS path, coalesce(s.length, p.length) AS length,
  CASE WHEN p.path IS NULL THEN 'new' WHEN s.path IS NULL THEN 'deleted'
       WHEN s.length = p.length AND s.mtime = p.mtime THEN 'same' ELSE 'changed' END AS change
FROM scan s FULL JOIN prior p ON s.path = p.path""")
def update_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    path = F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path")
    length = F.col("n_chars").alias("length")
    scan = docs.select(path, length, F.timestamp_seconds("n_chars").alias("mtime"))
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        path, length, F.timestamp_seconds(F.col("n_chars") + F.col("toxic")).alias("mtime"))
    gone = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("path"),
        F.length("text").cast("bigint").alias("length"), F.timestamp_seconds(F.length("text")).alias("mtime"))
    return index.diff_index(labelled.unionByName(gone), scan).select("path", "length", "change")


def listed_times(spark, sf_dir) -> list[DataFrame]:
    """Three listings: labelled documents and benchmark items, all documents, all but the toxic ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    path, length = F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("length")
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("path"),
                                                     F.length("text").cast("bigint").alias("length"), F.timestamp_seconds(F.length("text")).alias("mtime"))
    mtime = F.timestamp_seconds("n_chars").alias("mtime")
    early = docs.filter("toxic IS NOT NULL").select(path, length, F.timestamp_seconds(F.col("n_chars") + F.col("toxic")).alias("mtime"))
    return [early.unionByName(items), docs.select(path, length, mtime), docs.filter("toxic IS NULL OR toxic = 0").select(path, length, mtime)]


STREAM_INDEX = """
WITH d AS (SELECT concat('documents/', doc_id) AS path, n_chars, toxic FROM documents LEFT JOIN labels USING (doc_id)),
listed AS (
  SELECT 1 AS step, path, n_chars AS length, n_chars + toxic AS mtime FROM d WHERE toxic IS NOT NULL
  UNION ALL SELECT 1, concat('benchmark/', item_id), length(text), length(text) FROM benchmark
  UNION ALL SELECT 2, path, n_chars, n_chars FROM d
  UNION ALL SELECT 3, path, n_chars, n_chars FROM d WHERE toxic IS NULL OR toxic = 0)
SELECT coalesce(n.step, o.step + 1) AS step, coalesce(n.path, o.path) AS path, coalesce(n.length, o.length) AS length,
       CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM listed n FULL JOIN listed o ON n.path = o.path AND n.step = o.step + 1
WHERE coalesce(n.step, o.step + 1) <= 3 AND (n.path IS NULL OR o.path IS NULL OR n.length <> o.length OR n.mtime <> o.mtime)"""


def stream_index(spark, sf_dir):
    """One run of the stream per listing; each goes on from the state that the one before has left."""
    folder = fresh_dir(spark, "watch")
    for step, files_then in enumerate(listed_times(spark, sf_dir), 1):
        watch.add_listing(files_then, f"{folder}/listings", datetime(2024, 1, step, tzinfo=timezone.utc))
        watch.index_changes(spark, f"{folder}/listings", f"{folder}/changes", f"{folder}/state").awaitTermination()
    found = spark.read.schema(watch.CHANGES).option("recursiveFileLookup", True).parquet(f"{folder}/changes")
    return found.select(F.dayofmonth("seen_at").alias("step"), "path", "length", "change")


if watch.available():
    query("stream_index", STREAM_INDEX)(stream_index)


@query("browse", """
SELECT doc_id, lang, n_chars FROM documents
WHERE lang = 'en' AND (n_chars < 2500 OR (n_chars = 2500 AND doc_id > 0)) ORDER BY n_chars DESC, doc_id LIMIT 50""")
def browse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return index.browse(docs, F.col("lang") == "en", ["-n_chars"], after=(2500, 0), limit=50, key="doc_id")


DOCUMENT_FILES = """images AS (SELECT concat('docs/', source, '/', doc_id, '.png') AS path FROM documents),
texts AS (SELECT concat('docs/', source, '/', doc_id, '.txt') AS path,
                 concat('quality_', quality, ' toxic_', toxic) AS caption FROM documents JOIN labels USING (doc_id))"""


def document_files(spark, sf_dir, where=None):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    stem = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    images = (docs if where is None else docs.filter(where)).select(F.concat(stem, F.lit(".png")).alias("path"))
    texts = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.concat(stem, F.lit(".txt")).alias("path"),
        F.concat(F.lit("quality_"), F.col("quality").cast("string"), F.lit(" toxic_"), F.col("toxic").cast("string")).alias("caption"))
    return images, texts


@query("attach_captions", f"""
WITH {DOCUMENT_FILES}
SELECT i.path, t.caption FROM images i LEFT JOIN texts t ON replace(i.path, '.png', '') = replace(t.path, '.txt', '')""")
def attach_captions(spark, sf_dir):
    return index.attach_captions(*document_files(spark, sf_dir))


@query("orphan_captions", """
SELECT concat('docs/', source, '/', doc_id, '.txt') AS path, concat('quality_', quality, ' toxic_', toxic) AS caption
FROM documents JOIN labels USING (doc_id) WHERE lang <> 'en'""")
def orphan_captions(spark, sf_dir):
    images, texts = document_files(spark, sf_dir, F.col("lang") == "en")
    return index.orphan_captions(images, texts)


@query("archive_manifest", """
SELECT page_id, regexp_replace(url, '^https?://', '') AS member FROM pages""")
def archive_manifest(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("file:/web/"), F.regexp_replace("url", "^https?://", "")).alias("path"))
    return archives.archive_manifest(pages, "file:/web", "file:/web/set.zip").select("page_id", "member")


# ---- duplicates ------------------------------------------------------------

@query("exact_duplicates", """
SELECT sha256(text) AS hash, min(doc_id) AS group_id, count(*) AS n
FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(spark, sf_dir):
    return exact.exact_duplicates(documents(spark, sf_dir, "text"), "text")


def with_quality(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return documents(spark, sf_dir, "text").join(labels, "id", "left").withColumn("quality", F.coalesce("quality", F.lit(-1)))


RANKED_COPIES = """ranked AS (
  SELECT d.doc_id AS id, min(d.doc_id) OVER (PARTITION BY text) AS group_id, count(*) OVER (PARTITION BY text) AS n,
         first_value(d.doc_id) OVER (PARTITION BY text ORDER BY coalesce(quality, -1) DESC, d.doc_id) AS kept_id
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query("removals", f"WITH {RANKED_COPIES} SELECT id, group_id, kept_id FROM ranked WHERE id <> kept_id")
def removals(spark, sf_dir):
    docs = with_quality(spark, sf_dir)
    found = exact.copy_groups(docs, hs.content_hash(F.col("text")))
    return exact.removals(docs, found, [-F.col("quality")])


@query("keep_best", f"WITH {RANKED_COPIES} SELECT id FROM ranked WHERE id = kept_id")
def keep_best(spark, sf_dir):
    return curation.drop_copies(with_quality(spark, sf_dir), "text", [-F.col("quality")]).select("id")


@query("grid_fingerprint", """
WITH grid AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS g FROM embeddings),
bits AS (SELECT vec_id, list_transform(g, lambda x: CASE WHEN x > list_sum(g) / 64.0 THEN 1 ELSE 0 END) AS b FROM grid)
SELECT vec_id, list_sum(list_transform(range(32), lambda i: b[i + 1]::BIGINT << (31 - i)))::BIGINT AS hi,
       list_sum(list_transform(range(32), lambda i: b[i + 33]::BIGINT << (31 - i)))::BIGINT AS lo FROM bits""")
def grid_fingerprint(spark, sf_dir):
    grids = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("grid"))
    return fingerprints.grid_fingerprint(grids).select("vec_id", "hi", "lo")


SIMHASH = """words AS (
  SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM documents),
hashed AS (SELECT id, ('0x' || substr(md5(w), 1, 15))::BIGINT AS h FROM words),
simhash AS (
  SELECT id, list_sum(list_transform(range(60), lambda i: v[i + 1]))::BIGINT AS hash FROM (
    SELECT id, list(CASE WHEN s > 0 THEN 1::BIGINT << bit ELSE 0 END ORDER BY bit) AS v FROM (
      SELECT id, bit, sum(CASE WHEN (h >> bit) & 1 = 1 THEN 1 ELSE -1 END) AS s
      FROM hashed, range(60) r(bit) GROUP BY id, bit) GROUP BY id))"""


def document_simhash(spark, sf_dir):
    return fingerprints.simhash(documents(spark, sf_dir, "text"), hs.words(F.col("text")))


@query("simhash", f"WITH {SIMHASH} SELECT id, hash FROM simhash")
def simhash(spark, sf_dir):
    return document_simhash(spark, sf_dir)


@query("hamming_pairs", f"""
WITH {SIMHASH}, first AS (SELECT hash, min(id) AS id FROM simhash GROUP BY hash)
SELECT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b, bit_count(xor(a.hash, b.hash))::INTEGER AS distance
FROM first a JOIN first b ON a.hash < b.hash AND bit_count(xor(a.hash, b.hash)) <= 3
UNION ALL
SELECT f.id, s.id, 0 FROM simhash s JOIN first f ON s.hash = f.hash AND s.id <> f.id""")
def hamming_pairs(spark, sf_dir):
    return hamming.hamming_pairs(document_simhash(spark, sf_dir), 3, hs.SIMHASH_BITS)


@query("hamming_pairs_far", f"""
WITH {SIMHASH}, first AS (SELECT hash, min(id) AS id FROM simhash GROUP BY hash)
SELECT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b, bit_count(xor(a.hash, b.hash))::INTEGER AS distance
FROM first a JOIN first b ON a.hash < b.hash AND bit_count(xor(a.hash, b.hash)) <= 10
UNION ALL
SELECT f.id, s.id, 0 FROM simhash s JOIN first f ON s.hash = f.hash AND s.id <> f.id""")
def hamming_pairs_far(spark, sf_dir):
    return multi_index.hamming_pairs_far(document_simhash(spark, sf_dir), 10, hs.SIMHASH_BITS)


# Documents without a label are stored first, labelled ones arrive later.
LOADS = f"""
WITH RECURSIVE {SIMHASH}, loads AS (SELECT s.id, hash, l.doc_id IS NOT NULL AS late FROM simhash s LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = s.id),
edges AS (SELECT a.id AS u, b.id AS v, a.late OR b.late AS late FROM loads a JOIN loads b ON a.id <> b.id AND bit_count(xor(a.hash, b.hash)) <= 3),
reach(u, v) AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
early(u, v) AS (SELECT u, v FROM edges WHERE NOT late UNION SELECT r.u, e.v FROM early r JOIN edges e ON r.v = e.u WHERE NOT e.late),
grouped AS (SELECT u AS id, least(u, min(v)) AS group_id FROM reach GROUP BY u),
before AS (SELECT u AS id, least(u, min(v)) AS group_id FROM early GROUP BY u),
changes AS (SELECT g.id, g.group_id, b.group_id AS was FROM grouped g LEFT JOIN before b ON b.id = g.id WHERE b.group_id IS DISTINCT FROM g.group_id)"""


def two_loads(spark, sf_dir) -> tuple[copy_index.CopyIndex, DataFrame]:
    """An index that documents without a label were stored in, and the changes that the labelled ones then made."""
    hashes = cut(document_simhash(spark, sf_dir), "hashes")
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct()
    stored = copy_index.CopyIndex.create(spark, fresh_dir(spark, "copies"), 3, hs.SIMHASH_BITS)
    stored.add(hashes.join(labelled, "id", "left_anti"))
    return stored, stored.add(hashes.join(labelled, "id", "left_semi"))


@query("stored_groups", f"{LOADS} SELECT id, group_id FROM grouped")
def stored_groups(spark, sf_dir):
    return two_loads(spark, sf_dir)[0].groups()


@query("arrival_changes", f"{LOADS} SELECT id, group_id, was FROM changes")
def arrival_changes(spark, sf_dir):
    return two_loads(spark, sf_dir)[1].select("id", "group_id", "was")


@query("arrival_removals", f"""{LOADS},
ranked AS (SELECT id, group_id, first_value(id) OVER (PARTITION BY group_id ORDER BY n_chars DESC, id) AS kept_id
           FROM grouped JOIN documents ON doc_id = id WHERE group_id IN (SELECT group_id FROM changes))
SELECT id, group_id, kept_id FROM ranked WHERE id <> kept_id""")
def arrival_removals(spark, sf_dir):
    stored, changes = two_loads(spark, sf_dir)
    longest = documents(spark, sf_dir, (-F.col("n_chars")).alias("score"))
    return copy_index.displaced(stored.groups(), changes, longest)


JACCARD = """sets AS (
  SELECT doc_id AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''))) AS s
  FROM documents),
first AS (SELECT s, min(id) AS id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
near AS (
  SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.s, b.s)) AS i, a.n + b.n AS n
  FROM first a JOIN first b ON a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
pairs AS (
  SELECT id_a, id_b, i / (n - i)::DOUBLE AS score FROM near WHERE i * 100 >= (n - i) * 80
  UNION ALL SELECT f.id, s.id, 1.0 FROM sets s JOIN first f ON s.s = f.s AND s.id <> f.id)"""


def document_pairs(spark, sf_dir, all_pairs=True):
    return jaccard.jaccard_pairs(documents(spark, sf_dir, "text"), hs.words(F.col("text")), 0.8, all_pairs=all_pairs)


@query("jaccard_pairs", f"WITH {JACCARD} SELECT id_a, id_b, round(score, 6) AS score FROM pairs")
def jaccard_pairs(spark, sf_dir):
    return document_pairs(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("cosine_pairs", """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
first AS (SELECT e, min(id) AS id, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v GROUP BY e),
near AS (
  SELECT a.id AS id_a, b.id AS id_b, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 9) AS score
  FROM first a JOIN first b ON a.id < b.id AND a.norm > 0 AND b.norm > 0)
SELECT id_a, id_b, round(score, 6) AS score FROM near WHERE score >= 0.35
UNION ALL SELECT f.id, v.id, 1.0 FROM v JOIN first f ON v.e = f.e AND v.id <> f.id""")
def cosine_pairs(spark, sf_dir):
    return cosine.cosine_pairs(vectors(spark, sf_dir), 0.35, id_col="vec_id")


GROUPS = JACCARD + """, edges AS (SELECT id_a AS u, id_b AS v FROM pairs UNION SELECT id_b, id_a FROM pairs),
reach(u, v) AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
grouped AS (SELECT u AS id, least(u, min(v)) AS group_id FROM reach GROUP BY u)"""


@query("duplicate_groups", f"WITH RECURSIVE {GROUPS} SELECT id, group_id FROM grouped")
def duplicate_groups(spark, sf_dir):
    return groups.duplicate_groups(document_pairs(spark, sf_dir, all_pairs=False))


@query("drop_near_copies", f"""
WITH RECURSIVE {GROUPS}, ranked AS (
  SELECT id, row_number() OVER (PARTITION BY group_id ORDER BY coalesce(quality, -1) DESC, id) AS r
  FROM grouped LEFT JOIN labels ON id = doc_id)
SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT id FROM ranked WHERE r > 1)""")
def drop_near_copies(spark, sf_dir):
    return curation.drop_near_copies(with_quality(spark, sf_dir), "text", 0.8, [-F.col("quality")]).select("id")


@query("curated_tag_counts", f"""
WITH {DOCUMENT_TAGS}, survivors AS (SELECT min(doc_id) AS id FROM documents GROUP BY text),
long AS (SELECT id, unnest(list_distinct(tags)) AS tag FROM document_tags WHERE id IN (SELECT id FROM survivors))
SELECT tag, count(*) AS images, count(*) / (SELECT count(*) FROM survivors)::DOUBLE AS share FROM long GROUP BY tag""")
def curated_tag_counts(spark, sf_dir):
    return curation.curated_tag_counts(documents(spark, sf_dir, F.col("text").alias("caption")))


# ---- features and clusters -------------------------------------------------

@query("vector_features", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v)
SELECT vec_id, unnest(range(64)) AS pos, round(unnest(e) / norm, 6) AS value FROM n WHERE norm > 0""")
def vector_features(spark, sf_dir):
    unit = features.vector_features(vectors(spark, sf_dir), "features")
    return (unit.select("vec_id", F.posexplode("features").alias("pos", "value"))
            .select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value")))


@query("tfidf_features", f"""
WITH {TAGGED}, tf AS (SELECT id, tag, count(*) AS tf FROM (SELECT id, unnest(tags) AS tag FROM tagged) GROUP BY ALL),
df AS (SELECT tag, count(*) AS df FROM tf GROUP BY tag),
w AS (SELECT id, tag, tf, df, tf * ln(((SELECT count(*) FROM tagged) + 1) / (df + 1)::DOUBLE) AS weight FROM tf JOIN df USING (tag)),
n AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY id)
SELECT id, tag, tf, df, round(CASE WHEN norm > 0 THEN weight / norm ELSE 0 END, 6) AS weight FROM w JOIN n USING (id)""")
def tfidf_features(spark, sf_dir):
    return (features.tfidf_features(tagged_rows(spark, sf_dir))
            .select("id", "tag", F.col("tf").cast("bigint").alias("tf"), "df", F.round("weight", 6).alias("weight")))


VECTORS = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
long AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(e) AS x FROM v),
c0 AS (SELECT cluster, list(m ORDER BY i) AS c FROM (
         SELECT label AS cluster, i, round(avg(x), 9) AS m FROM long GROUP BY ALL) GROUP BY cluster)"""


def assigned_sql(number: int) -> str:
    return f"""a{number} AS (
  SELECT vec_id, label, e, cluster, d AS distance FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS r FROM (
      SELECT v.*, k.cluster, round(list_sum(list_transform(range(64), lambda i: (e[i + 1] - c[i + 1]) * (e[i + 1] - c[i + 1]))), 9) AS d
      FROM v, c{number} k)) WHERE r = 1)"""


def updated_sql(number: int) -> str:
    return f"""c{number + 1} AS (
  SELECT k.cluster, coalesce(m.c, k.c) AS c FROM c{number} k LEFT JOIN (
    SELECT cluster, list(m ORDER BY i) AS c FROM (
      SELECT cluster, i, round(avg(x), 9) AS m FROM (
        SELECT cluster, unnest(range(64)) AS i, unnest(e) AS x FROM a{number}) GROUP BY ALL) GROUP BY cluster) m
  ON k.cluster = m.cluster)"""


ASSIGNED = f"{VECTORS}, {assigned_sql(0)}"


def assigned(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return clusters.assign_clusters(rows, clusters.mean_centroids(rows, "label"))


@query("assign_clusters", f"WITH {ASSIGNED} SELECT vec_id, cluster, round(distance, 6) AS distance FROM a0")
def assign_clusters(spark, sf_dir):
    return assigned(spark, sf_dir).select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query("lloyd_clusters", f"""
WITH {ASSIGNED}, {updated_sql(0)}, {assigned_sql(1)}, {updated_sql(1)}, {assigned_sql(2)}, {updated_sql(2)}, {assigned_sql(3)}
SELECT vec_id, cluster FROM a3""")
def lloyd_clusters(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    start = cut(clusters.mean_centroids(rows, "label"), "start")
    fitted = clusters.fit_clusters(rows, start.count(), "lloyd", start, rounds=3, id_col="vec_id")
    return clusters.assign_clusters(rows, fitted).select("vec_id", "cluster")


@query("cluster_quality", f"""
WITH {ASSIGNED}, n AS (SELECT cluster, label, count(*) AS n FROM a0 GROUP BY ALL)
SELECT cluster, sum(n)::BIGINT AS rows, max(n) AS majority, max(n) / sum(n)::DOUBLE AS purity FROM n GROUP BY cluster""")
def cluster_quality(spark, sf_dir):
    return clusters.cluster_purity(assigned(spark, sf_dir))


@query("silhouette", f"""
WITH {ASSIGNED}, d AS (
  SELECT a.vec_id, a.cluster, b.cluster AS other, count(*) AS n,
         sum(list_sum(list_transform(range(64), lambda i: (a.e[i + 1] - b.e[i + 1]) * (a.e[i + 1] - b.e[i + 1])))) AS s
  FROM a0 a, a0 b GROUP BY ALL),
w AS (SELECT vec_id, max(CASE WHEN cluster = other THEN s / greatest(n - 1, 1) END) AS a,
             max(CASE WHEN cluster = other THEN n END) AS n, min(CASE WHEN cluster <> other THEN s / n END) AS b
      FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN n = 1 OR a = b THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM w""")
def silhouette(spark, sf_dir):
    score = clusters.silhouette(assigned(spark, sf_dir))
    return spark.createDataFrame([(round(score, 6),)], "silhouette double")


@query("cluster_summary", f"""
WITH {ASSIGNED}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, vec_id) AS r FROM a0),
t AS (SELECT cluster, 'label ' || label AS tag, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, 'label ' || label) AS r
      FROM a0 GROUP BY cluster, label)
SELECT cluster, (SELECT count(*) FROM a0 WHERE a0.cluster = r.cluster) AS size, string_agg(vec_id::VARCHAR, '|' ORDER BY r.r) AS nearest,
  (SELECT string_agg(tag, '|' ORDER BY t.r) FROM t WHERE t.cluster = r.cluster AND t.r <= 3) AS top_tags
FROM r WHERE r.r <= 3 GROUP BY cluster""")
def cluster_summary(spark, sf_dir):
    rows = assigned(spark, sf_dir)
    tag_rows = rows.select(F.col("vec_id").alias("id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("tag"))
    summary = clusters.cluster_summary(rows, 3, tag_rows, "vec_id")
    return summary.select("cluster", "size", F.array_join(F.col("nearest").cast("array<string>"), "|").alias("nearest"),
                          joined("top_tags").alias("top_tags"))


@query("write_by_cluster", f"WITH {ASSIGNED} SELECT vec_id, cluster FROM a0")
def write_by_cluster(spark, sf_dir):
    folder = fresh_dir(spark, "clustered")
    tables.write_by_cluster(assigned(spark, sf_dir).select("vec_id", "cluster"), folder, id_col="vec_id")
    return spark.read.schema("vec_id bigint, cluster int").parquet(folder)


@query("infer_batch", "SELECT doc_id AS id, length(text) AS n FROM documents")
def infer_batch(spark, sf_dir):
    def count_characters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"id": rows["id"], "n": rows["text"].str.len()})

    return batch.infer_batch(documents(spark, sf_dir, "text"), count_characters, "id bigint, n bigint")


# ---- images and files ------------------------------------------------------

def grey_images(spark, sf_dir) -> DataFrame:
    """Vectors as 8 x 8 grey images, one byte per value."""
    level = F.transform("embedding", lambda x: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (x.cast("double") + 0.5) * 255))))
    data = F.unhex(F.array_join(F.transform(level, lambda p: F.lpad(F.hex(p), 2, "0")), ""))
    image = F.struct(F.lit("").alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"),
                     F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data"))
    return table(spark, sf_dir, "embeddings").select("vec_id", image.alias("image"))


PIXELS = """pixels AS (SELECT vec_id, list_transform(embedding,
  lambda x: floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, (x::DOUBLE + 0.5) * 255)))::BIGINT) AS p FROM embeddings)"""


@query("thumbnail", f"""
WITH {PIXELS}, cells AS (SELECT vec_id, p, unnest(range(16)) AS pos FROM pixels)
SELECT vec_id, pos, floor((p[(pos // 4) * 16 + (pos % 4) * 2 + 1] + p[(pos // 4) * 16 + (pos % 4) * 2 + 2]
  + p[(pos // 4) * 16 + (pos % 4) * 2 + 9] + p[(pos // 4) * 16 + (pos % 4) * 2 + 10]) / 4.0 + 0.5)::BIGINT AS value FROM cells""")
def thumbnail(spark, sf_dir):
    small = quality.thumbnail(grey_images(spark, sf_dir), 4).filter("image.height = 4 and image.width = 4")
    pos = F.explode(F.sequence(F.lit(0), F.length("image.data") - 1))
    return (small.select("vec_id", "image", pos.alias("pos"))
            .select("vec_id", F.col("pos").cast("bigint").alias("pos"),
                    F.conv(F.hex(F.expr("substring(image.data, pos + 1, 1)")), 16, 10).cast("bigint").alias("value")))


@query("image_fingerprint", f"""
WITH {PIXELS}, bits AS (SELECT vec_id, list_transform(p, lambda x: CASE WHEN x > list_sum(p) / 64.0 THEN 1 ELSE 0 END) AS b FROM pixels)
SELECT vec_id, list_sum(list_transform(range(32), lambda i: b[i + 1]::BIGINT << (31 - i)))::BIGINT AS hi,
       list_sum(list_transform(range(32), lambda i: b[i + 33]::BIGINT << (31 - i)))::BIGINT AS lo FROM bits""")
def image_fingerprint(spark, sf_dir):
    return fingerprints.image_fingerprint(grey_images(spark, sf_dir)).select("vec_id", "hi", "lo")


def png_files(spark, sf_dir) -> DataFrame:
    """Documents as PNG bytes: a one-pixel image that carries the text as metadata."""
    def chunk(kind: str, body: Column) -> Column:
        named = F.concat(F.encode(F.lit(kind), "UTF-8"), body)
        return F.concat(F.unhex(F.lpad(F.hex(F.length(body)), 8, "0")), named, F.unhex(F.lpad(F.hex(F.crc32(named)), 8, "0")))

    def raw(digits: str) -> Column:
        return F.unhex(F.lit(digits))

    text = F.concat(F.encode(F.lit("parameters"), "UTF-8"), raw("0000000000"), F.encode("text", "UTF-8"))
    content = F.concat(raw("89504E470D0A1A0A"), chunk("IHDR", raw("00000001000000010800000000")), chunk("iTXt", text),
                       chunk("IDAT", raw("789C6360000000020001")), chunk("IEND", raw("")))
    return documents(spark, sf_dir, "n_chars", "text").select("id", "n_chars", content.alias("content"))


@query("read_generation_info", "SELECT doc_id AS id, text AS parameters, NULL::VARCHAR AS error FROM documents")
def read_generation_info(spark, sf_dir):
    info = image_info.read_generation_info(png_files(spark, sf_dir).select("id", "content"), content="content")
    return info.select("id", F.col("info")["parameters"].alias("parameters"), "error")


def tagged_photos(spark, sf_dir) -> DataFrame:
    """Documents as Exif comments: of JPEG files if they are short enough and of even length, else of WebP files.

    Every seventh directory of tags names itself as the next one.
    """
    def number(value: Column, size: int, little: bool = False) -> Column:
        if not little:
            return F.unhex(F.lpad(F.hex(value), 2 * size, "0"))
        return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftrightunsigned(value.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(size)])

    def raw(digits: str) -> Column:
        return F.unhex(F.lit(digits))

    docs = documents(spark, sf_dir, "n_chars", "text", "source")
    artist = F.concat(F.encode(F.concat(F.lit("source "), F.coalesce("source", F.lit(""))), "UTF-8"), raw("00"))
    comment = F.concat(raw("554E49434F444500"), F.encode("text", "UTF-16BE"))
    docs = docs.select("id", "n_chars", artist.alias("artist"), comment.alias("comment"))
    a, c = F.length("artist"), F.length("comment")
    following = F.when(F.col("n_chars") % 7 == 0, raw("00000008")).otherwise(raw("00000000"))
    tags_of = F.concat(raw("4D4D002A000000080002013B0002"), number(a, 4), raw("00000038" "8769000400000001" "00000026"), following,
                       raw("000192860007"), number(c, 4), number(a + 56, 4), raw("00000000"), F.col("artist"), F.col("comment"))
    docs = docs.withColumn("tags", tags_of)
    size = F.length("tags")
    jpeg = F.concat(raw("FFD8FFE000104A46494600010100000100010000FFE1"), number(size + 8, 2), raw("457869660000"), F.col("tags"), raw("FFDA0002FFD9"))
    chunks = F.concat(raw("57454250565038580A00000008000000000000000000"), raw("45584946"), number(size, 4, True), F.col("tags"),
                      F.when(size % 2 == 1, raw("00")).otherwise(raw("")))
    webp = F.concat(raw("52494646"), number(F.length(chunks), 4, True), chunks)
    short = (F.col("n_chars") % 2 == 0) & (size < 65_000)
    return docs.select("id", F.when(short, jpeg).otherwise(webp).alias("content"))


@query("read_photo_info", """
SELECT doc_id AS id, CASE WHEN n_chars % 7 <> 0 THEN text END AS parameters, CASE WHEN n_chars % 7 <> 0 THEN concat('source ', source) END AS artist,
       CASE WHEN n_chars % 7 = 0 THEN 'ValueError: Exif directories in a cycle' END AS error FROM documents""")
def read_photo_info(spark, sf_dir):
    info = image_info.read_generation_info(tagged_photos(spark, sf_dir), content="content")
    return info.select("id", image_info.parameters(F.col("info")).alias("parameters"), F.col("info")["Artist"].alias("artist"), "error")


@query("check_images", """
SELECT doc_id AS id, CASE WHEN n_chars % 2 = 1 THEN 'truncated' END AS problem FROM documents""")
def check_images(spark, sf_dir):
    cut_off = F.when(F.col("n_chars") % 2 == 1, F.expr("substring(content, 1, length(content) - 20)")).otherwise(F.col("content"))
    return quality.check_content(png_files(spark, sf_dir).withColumn("content", cut_off), quality.REPORT).select("id", "problem")


def caption_folder(spark, sf_dir) -> str:
    folder = fresh_dir(spark, "captions")
    docs = table(spark, sf_dir, "documents")
    captions.write_captions(docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"),
                                        F.col("text").alias("caption")), folder)
    return folder


@query("write_captions", """
SELECT concat(source, '/', doc_id, '.txt') AS name, text AS caption FROM documents""")
def write_captions(spark, sf_dir):
    texts = captions.read_captions(spark, [caption_folder(spark, sf_dir)])
    return texts.select(F.substring_index("path", "/", -2).alias("name"), "caption")


@query("scan_files", """
SELECT concat(source, '/', doc_id, '.txt') AS name, octet_length(encode(text)) AS length FROM documents""")
def scan_files(spark, sf_dir):
    found = files.scan_files(spark, [caption_folder(spark, sf_dir)])
    return found.select(F.substring_index("path", "/", -2).alias("name"), "length")


@query("archive_round_trip", """
SELECT concat(source, '/', doc_id, '.txt') AS member, octet_length(encode(text)) AS length, sha256(text) AS hash,
       NULL::VARCHAR AS error FROM documents""")
def archive_round_trip(spark, sf_dir):
    folder, packed = caption_folder(spark, sf_dir), fresh_dir(spark, "archive")
    archives.export_archive(files.scan_files(spark, [folder]), folder, packed, shards=4)
    members = archives.import_archive(files.scan_files(spark, [packed], "*.zip"))
    return members.select("member", "length", F.sha2("content", 256).alias("hash"), "error")


@query("extract_archive", """
SELECT concat(source, '/', doc_id, '.txt') AS member, octet_length(encode(text)) AS length, text AS caption, NULL::VARCHAR AS error
FROM documents""")
def extract_archive(spark, sf_dir):
    folder, packed, out = caption_folder(spark, sf_dir), fresh_dir(spark, "archive"), fresh_dir(spark, "extracted")
    archives.export_archive(files.scan_files(spark, [folder]), folder, packed, shards=4)
    done = cut(archives.extract_archive(files.scan_files(spark, [packed], "*.zip"), out), "done")
    texts = captions.read_captions(spark, [out]).select(F.substring_index("path", "/", -2).alias("member"), "caption")
    return done.join(texts, "member", "left").select("member", "length", "caption", "error")


@query("cosine_pairs_lsh")
def cosine_pairs_lsh(spark, sf_dir):
    return cosine.cosine_pairs(table(spark, sf_dir, "embeddings"), 0.35, "embedding", "vec_id", mode="lsh")


@query("jaccard_pairs_lsh")
def jaccard_pairs_lsh(spark, sf_dir):
    return jaccard.jaccard_pairs(documents(spark, sf_dir, "text"), hs.words(F.col("text")), 0.8, mode="lsh")


@query("curation_flow", """
WITH first AS (SELECT text, min(concat(source, '/', doc_id, '.txt')) AS member FROM documents GROUP BY text)
SELECT member, octet_length(encode(text)) AS length,
       len(list_filter(list_transform(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ','), lambda t: trim(t)), lambda t: t <> ''))::INTEGER AS tags
FROM first""")
def curation_flow(spark, sf_dir):
    """Files on disk to an archive: scan, captions, copies dropped, tags parsed, export, listing."""
    folder, packed = caption_folder(spark, sf_dir), fresh_dir(spark, "archive")
    found = files.scan_files(spark, [folder])
    paired = found.join(captions.read_captions(spark, [folder]), "path")
    unique = cut(curation.drop_copies(paired, "caption", id_col="path"), "unique")
    archives.export_archive(unique, folder, packed, shards=4)
    members = archives.list_members(files.scan_files(spark, [packed], "*.zip"))
    counted = tags.parse_tags(unique).select(F.substring_index("path", "/", -2).alias("member"), F.size("tags").alias("tags"))
    return members.join(counted, "member", "left").select("member", "length", "tags")
