"""One query per text operator over the given tables, with the same query in SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm import classify, decontaminate, html, merkle, mix, near, pitmanyor, repeats, rules, tokens, topk, warc, whiten
from lumisift.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


# Lower-cased words split at the six white-space characters; distinct 4-word shingles.
_OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.root) AS component_id, s.doc_id = min(r.root) AS kept
FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id, s.s
"""


@query("op4_near_duplicates", _OP4)
def op4_near_duplicates(spark, sf_dir):
    return near.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


@query("op5_repeated_passages")
def op5_repeated_passages(spark, sf_dir):
    return repeats.passage_report(table(spark, sf_dir, "documents"), window=200)


# Windows of 10 words, or whole items of fewer, looked up among all runs of as many words.
_OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op7_benchmark_passages", _OP7)
def op7_benchmark_passages(spark, sf_dir):
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


# Filling by level: sources in order of the level that fills them; queue order by the hash of the id.
_OP8 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS k
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
      FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
             coalesce(sum(2.0::DOUBLE * source_size) OVER w, 0) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open
      FROM s WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min((budget - filled) / open, most / weight) AS level FROM r WHERE (budget - filled) / open <= most / weight),
t AS (SELECT source, source_size, least(most, level * weight) AS target FROM r, v),
q AS (SELECT doc_id, size, source_size, target, k, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size) AS sent
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, size, k, p, (p * source_size + sent)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) AS x(p) WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, k, p) AS upto FROM c),
e AS (SELECT doc_id, k, sum(size)::BIGINT AS taken FROM o WHERE upto - size < 1.5 * (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(e.taken, 0)::BIGINT AS taken FROM q LEFT JOIN e USING (doc_id, k)
"""


@query("op8_source_mix", _OP8)
def op8_source_mix(spark, sf_dir):
    return mix.fair_mix(table(spark, sf_dir, "documents"), weights=[3, 1, 2])


@query("op1_quality_classifier")
def op1_quality_classifier(spark, sf_dir):
    return classify.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_quality_rules")
def op3_quality_rules(spark, sf_dir):
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# The counts and the base score; the sampled model's score has no counterpart in SQL.
@query("op2_word_model")
def op2_word_model(spark, sf_dir):
    return pitmanyor.score_texts(table(spark, sf_dir, "documents"))


_OP6 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d HAVING count(*) > 1)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""


@query("op6_warc_round_trip", _OP6)
def op6_warc_round_trip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


# Where the vocabulary files of public tokenizers are; any path that Spark can read.
VOCABULARY = os.environ.get("LUMISIFT_VOCABULARY", "file:///opt/tokenizers/piece_bpe_32k.model")


@query("op9_token_counts")
def op9_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


@query("op10_main_text")
def op10_main_text(spark, sf_dir):
    return html.extract_main_text(table(spark, sf_dir, "pages"))


_OP11 = r"""
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS x, rowid_ FROM (SELECT *, row_number() OVER () AS rowid_ FROM embeddings)
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT q.rowid_ AS asker, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.rowid_ <> c.rowid_ WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY asker ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""


@query("op11_top_products", _OP11)
def op11_top_products(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


# Trees of all sources level by level (negative: the tree of their roots); crc32 bit by bit.
_OP12 = r"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
           lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
                                      lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT) + z)) AS inverse FROM documents),
f AS (SELECT *, concat(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
             coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-'),
             coalesce(octet_length(encode(text)) || ':', '-')) AS head FROM d),
l AS (SELECT doc_id, source, sha256(head || coalesce(text, '')) AS leaf,
             CASE WHEN xor(inverse, 4294967295::UBIGINT) % 5 = 0
                  THEN sha256(head || coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''))
                  ELSE sha256(head || coalesce(text, '')) END AS seen FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
             dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM l),
t AS (SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM r
      UNION ALL
      SELECT tree, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY tree, lvl, pos // 16, n),
s AS (SELECT tree, h FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, tree AS pos, (SELECT count(*) FROM s) AS n, h FROM s
      UNION ALL
      SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 16, n),
tall AS (SELECT tree, max(lvl) AS tall FROM t GROUP BY tree),
nodes AS (SELECT tree, lvl AS step, pos, h FROM t WHERE n > 1
          UNION ALL SELECT tree, tall + lvl, pos, h FROM u, tall WHERE n > 1),
own AS (SELECT r.doc_id, r.tree, r.pos, leaf, seen, k AS step, CASE WHEN k < tall THEN r.pos // power(16, k)::BIGINT ELSE r.tree // power(16, k - tall)::BIGINT END AS at
        FROM r JOIN tall USING (tree), (SELECT unnest(range(0, 15)) AS k)),
proofs AS (SELECT o.tree, o.pos, sha256(string_agg(h, '' ORDER BY o.step, nodes.pos)) AS proof
           FROM own o JOIN nodes ON o.tree = nodes.tree AND o.step = nodes.step AND o.at // 16 = nodes.pos // 16 AND o.at <> nodes.pos GROUP BY o.tree, o.pos),
folds AS (SELECT tree, pos, 0 AS step, seen AS h FROM r
          UNION ALL
          SELECT folds.tree, folds.pos, folds.step + 1, sha256(string_agg(CASE WHEN nodes.pos = o.at THEN folds.h ELSE nodes.h END, '' ORDER BY nodes.pos))
          FROM folds JOIN own o ON folds.tree = o.tree AND folds.pos = o.pos AND folds.step = o.step
          JOIN nodes ON nodes.tree = o.tree AND nodes.step = o.step AND nodes.pos // 16 = o.at // 16 GROUP BY folds.tree, folds.pos, folds.step),
folded AS (SELECT tree, pos, arg_max(h, step) AS h FROM folds GROUP BY tree, pos)
SELECT r.doc_id, r.leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256,
       folded.h AS folded_root, folded.h = (SELECT h FROM u WHERE n = 1) AS verified
FROM r JOIN s USING (tree) JOIN folded USING (tree, pos) LEFT JOIN proofs USING (tree, pos)
"""


@query("op12_merkle_manifest", _OP12)
def op12_merkle_manifest(spark, sf_dir):
    return merkle.tampering_report(table(spark, sf_dir, "documents"))


@query("op13_whitened_embeddings")
def op13_whitened_embeddings(spark, sf_dir):
    return whiten.whiten(table(spark, sf_dir, "embeddings"), components=8, scale=1024, shift=100_000)
