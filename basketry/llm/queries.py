"""Registered queries of this subpackage, each over its whole table, and the DuckDB
SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import (bpe, centroids, decontaminate, dual_tree, html_extract, line_dedup, pii, quality, secret_scan,
                          set_join, simhash, toxicity, warc)
from basketry.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


@query("op4_line_dedup", sql="""
WITH split AS (
  SELECT doc_id, s.i, string_split(coalesce(text, ''), chr(10))[s.i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i) s),
keyed AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split),
often AS (
  SELECT k, max(doc_id) AS largest FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (largest IS NOT NULL AND largest <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i)
              FILTER (largest IS NULL OR largest = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN often USING (k) GROUP BY doc_id""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


_WORDS = """list_filter(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"""
_SHINGLES = """unnest(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1),
  lambda i: array_to_string(list_slice(w, i, i + 4), ' '))))"""


@query("op5_decontamination", sql=f"""
WITH items AS (
  SELECT DISTINCT item_id, text, {_WORDS} AS w FROM benchmark),
item_shingles AS (SELECT item_id, text, least(5, len(w)) AS width, {_SHINGLES} AS s FROM items WHERE len(w) > 0),
sizes AS (SELECT item_id, text, count(*) AS n_shingles FROM item_shingles GROUP BY ALL),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
doc_shingles AS (
  SELECT doc_id, 5 AS width, {_SHINGLES} AS s FROM docs WHERE len(w) > 0
  UNION ALL
  SELECT doc_id, k AS width, unnest(list_distinct(list_transform(range(1, len(w) - k + 2),
    lambda i: array_to_string(list_slice(w, i, i + k - 1), ' ')))) AS s
  FROM docs, (SELECT DISTINCT len(w) AS k FROM items WHERE len(w) BETWEEN 1 AND 4) WHERE len(w) >= k),
shared AS (SELECT doc_id, item_id, text, count(*) AS n_shared
  FROM doc_shingles JOIN item_shingles USING (s, width) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM shared JOIN sizes USING (item_id, text) WHERE n_shared >= 0.8 * n_shingles""")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op1_html_extract")
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_warc", sql="""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT h, max(page_id) AS largest, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST(((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS INTEGER), 1)), '')
    AS payload_digest FROM p GROUP BY h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM p JOIN d USING (h)""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def _clustering_sql(rounds: int = 5, k: int = 40) -> str:
    ctes = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS k, v AS c FROM kept
  WHERE vec_id IS NOT NULL QUALIFY k < {k})"""]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, v, k, d FROM (
    SELECT r, vec_id, v, k, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d
    FROM kept, c{i}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if i < rounds:
            ctes.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT k, coalesce(m, c) AS c FROM c{i} LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
      SELECT k, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
      FROM a{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY k, i) GROUP BY k) USING (k))""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance,
       CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)"""


@query("op11_centroid_clustering", sql=_clustering_sql())
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


_TERMS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[0-9a-z\\x{80}-\\x{10FFFF}]+')"""


@query("op12_lexical_search", sql=f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
lengths AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM lengths),
items AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark),
wanted AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(t) AS term FROM items) GROUP BY ALL),
found AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM found, total GROUP BY term, nn),
scores AS (
  SELECT q, item_id, doc_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * nn) // l))))) AS BIGINT) AS score
  FROM wanted JOIN found USING (term) JOIN weights USING (term) JOIN lengths USING (r), total GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20""")
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_set_join")
def op13_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.components(table(spark, sf_dir, "documents"))
