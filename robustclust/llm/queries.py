"""The queries of the pipeline operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from robustclust.llm import decontaminate, jaccard, langid, media, mixing, quality, secret_scan, substring_dedup, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_pu(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op2_decontaminate(spark, sf_dir):
    out = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.drop("text_md5")


def op3_language_ecoc(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op4_secrets(spark, sf_dir):
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op5_toxicity_cnn(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_mix_pivotal(spark, sf_dir):
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "copies * size AS taken", "copies")


def op7_warc_index(spark, sf_dir):
    index = warc.archive_and_index(_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_groups(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_media_avi(spark, sf_dir):
    return media.digest(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    ops = (
        op1_quality_pu,
        op2_decontaminate,
        op3_language_ecoc,
        op4_secrets,
        op5_toxicity_cnn,
        op6_mix_pivotal,
        op7_warc_index,
        op8_ngram_jaccard,
        op9_media_avi,
        op10_substring_dedup,
    )
    return {f.__name__: f for f in ops}


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH it AS (SELECT item_id, {_ALNUM_WORDS.format("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len, array_to_string(w[i:i + len - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS len, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM it WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({_ALNUM_WORDS.format("text")}, []) AS w FROM documents),
pos AS (
  SELECT doc_id, i, l.len, array_to_string(w[i:i + l.len - 1], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) p, (SELECT DISTINCT len FROM win) l WHERE i + l.len - 1 <= len(w)),
met AS (SELECT p.doc_id, p.i, p.len, win.item_id FROM pos p JOIN win ON p.win = win.win AND p.len = win.len),
hits AS (SELECT doc_id, count(DISTINCT w_at) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS w_at FROM (SELECT DISTINCT doc_id, i, len FROM met)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS least FROM h WHERE n >= 100 GROUP BY digest)
SELECT h.page_id, CAST(n AS BIGINT) AS payload_bytes, h.digest AS payload_digest,
  CASE WHEN n >= 100 AND h.page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND h.page_id > least THEN least END AS refers_to
FROM h LEFT JOIN f ON h.digest = f.digest
"""


_SPACE_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"

OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_SPACE_WORDS.format("text")}, []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = d.doc_id
"""

OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
p AS (SELECT doc_id, c, substr(h, 2 * c + 1, 598) AS h FROM (SELECT doc_id, h, unnest(range(0, n - 49, 250)) AS c FROM b WHERE n >= 50)),
w AS (SELECT doc_id, c + j AS i, md5(substr(h, 2 * j + 1, 100)) AS k FROM (SELECT doc_id, c, h, unnest(range(0, least(250, length(h) // 2 - 49))) AS j FROM p)),
f AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
m AS (SELECT w.doc_id, w.i FROM w JOIN f ON w.k = f.k WHERE w.doc_id > f.least),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
      FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM m)),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, max(z) OVER (PARTITION BY doc_id) AS last FROM r),
kept AS (
  SELECT k.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * any_value(last) + 1) AS h,
    sum(z - a) AS n_removed, count(*) AS n_spans
  FROM k JOIN b ON k.doc_id = b.doc_id GROUP BY k.doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept.h, b.h))) AS kept_sha256
FROM b LEFT JOIN kept ON b.doc_id = kept.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op7_warc_index": OP7_SQL, "op8_ngram_jaccard": OP8_SQL, "op10_substring_dedup": OP10_SQL}
