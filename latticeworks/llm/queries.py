"""The corpus operators as queries over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, quality, secret_scan, shards, suffix, token_counts, topk, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(table(spark, sf_dir, "documents"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = shards.reshard(table(spark, sf_dir, "documents"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return back.select("doc_id", "lang", "source", "n_chars", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("text_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_bpe, op2_jaccard, op3_quality, op4_suffix, op5_shards, op6_secrets, op7_topk, op8_warc, op9_token_counts, op10_decontaminate)}


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT r, 0 AS k, 'assign' AS kind, 8 AS least,
    regexp_split_to_array(t, {assign}) AS gaps, regexp_extract_all(t, {assign}) AS hits, regexp_extract_all(t, {assign}, 2) AS counted FROM d
  UNION ALL SELECT r, 1, 'access', 16, regexp_split_to_array(t, {access}), regexp_extract_all(t, {access}), regexp_extract_all(t, {access}) FROM d
  UNION ALL SELECT r, 2, 'hex', 32, regexp_split_to_array(t, {hex}), regexp_extract_all(t, {hex}), regexp_extract_all(t, {hex}) FROM d
),
u AS (
  SELECT r, k, kind, least, unnest(range(1, len(hits) + 1)) AS i, unnest(list_transform(gaps[:len(hits)], lambda x: length(x))) AS g,
    unnest(list_transform(hits, lambda x: length(x))) AS n, unnest(list_transform(counted, lambda x: length(x))) AS c FROM m WHERE len(hits) > 0
),
s AS (SELECT r, k, kind, n, c >= least AS ok, sum(g + n) OVER (PARTITION BY r, k ORDER BY i) AS e FROM u),
g AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || (e - n)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - n, k) AS spans
  FROM s WHERE ok GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(spans, '') AS spans, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN g USING (r)
""".format(
    assign=r"""'(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'""",
    access="'AKIA[A-Z0-9]+'", hex="'[0-9a-f]+'",
)

OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
iw AS (
  SELECT item_id, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0
),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM iw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
occ AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM dw),
hit AS (SELECT r, i, n, item_id FROM occ JOIN win USING (n, x)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hit) GROUP BY r),
its AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS name FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN its USING (r)
"""


OP5_SQL = """
SELECT doc_id, lang, source, n_chars, strlen(coalesce(text, ''))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents
"""

OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP8_SQL = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, url, coalesce(html, '') AS t FROM pages),
b AS (
  SELECT *, sha1(t) AS h, max(page_id) OVER w AS response_id, row_number() OVER (PARTITION BY t, page_id ORDER BY url) AS n
  FROM p WINDOW w AS (PARTITION BY t)
),
bits AS (
  SELECT r, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
    ('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31), 1), '' ORDER BY i) AS d
  FROM b, range(32) AS x(i) GROUP BY r
)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = response_id AND n = 1 OR response_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = response_id AND n = 1 THEN NULL ELSE response_id END AS refers_to
FROM b JOIN bits USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_shards": OP5_SQL, "op6_secrets": OP6_SQL, "op7_topk": OP7_SQL, "op8_warc": OP8_SQL, "op10_decontaminate": OP10_SQL}
