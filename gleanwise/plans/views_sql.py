"""The views of `sources.views` in SQL, as common table expressions."""

from __future__ import annotations

PROBES = """
probes0 AS (
  SELECT event_id AS id, (epoch_us(ts) - 1704067200000000) // 1000000 AS ts, 'e' || (user_id % 12) AS engine, event_type AS query,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, user_id, value
  FROM events
), probes AS (
  SELECT id, ts, engine, query, k, CASE WHEN k % 5 = 0 THEN 'images' WHEN k % 13 <> 0 THEN 'general' END AS category,
         k % 11 AS results, k % 7 AS relevant,
         CASE WHEN k <> 50 THEN CAST(value >= 5 * (user_id % 12) AS INTEGER) END AS hit, CAST(floor(value) AS INTEGER) AS latency,
         CASE WHEN query = 'error' THEN 'refused' WHEN k % 11 = 0 THEN 'empty' WHEN k % 7 = 0 THEN 'irrelevant'
              WHEN k = 50 OR value < 5 * (user_id % 12) THEN 'miss' ELSE 'ok' END AS verdict
  FROM probes0
)"""

READS = (
    PROBES
    + """, reads AS (
  SELECT id, ts, 'https://site' || (id % 20) || '.example.com/p' AS url, CASE k % 2 WHEN 0 THEN 'plain' ELSE 'browser' END AS path,
         CASE WHEN k % 8 = 0 THEN 'stub' ELSE 'read' END AS expected,
         CASE WHEN k % 4 = 0 THEN 'stub' WHEN k % 9 = 0 THEN 'error' ELSE 'read' END AS status,
         CAST(CASE WHEN k % 8 = 0 THEN true WHEN k % 4 = 0 OR k % 9 = 0 THEN false ELSE true END AS INTEGER) AS hit, latency, k * 100 AS chars
  FROM probes
)"""
)

ENGINE_URLS = """
engine_urls AS (
  SELECT 'e' || (l_suppkey % 12) AS engine, l_returnflag AS query, 'u' || l_partkey AS url
  FROM lineitem WHERE l_partkey % (1 + l_suppkey % 4) = 0
)"""

RESPONSES = """
hits0 AS (
  SELECT o_orderpriority AS query, CAST(l_suppkey % 12 AS INTEGER) AS pos, l_partkey, min((l_partkey * 7919 + l_suppkey % 3) % 1009) AS h
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
), hits1 AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query, pos ORDER BY h, l_partkey) AS INTEGER) AS rank FROM hits0 QUALIFY rank <= 10
), responses AS (
  SELECT query, pos, 'e' || pos AS engine, 'https://www.p' || (l_partkey % 40) || '.example.com/i/' || l_partkey AS url, p_name AS title,
         p_type || CASE WHEN l_partkey % 3 = 0 THEN ' ' || query ELSE '' END AS snippet, rank
  FROM hits1 JOIN part ON p_partkey = l_partkey
)"""

SOURCES = """
sources AS (
  SELECT source AS question, doc_id AS id, text, lang, length(text) AS chars,
         's' || (doc_id % 37) || CASE WHEN doc_id % 11 = 0 THEN '.sec.gov' ELSE '.example.org' END AS domain,
         'https://s' || (doc_id % 37) || CASE WHEN doc_id % 11 = 0 THEN '.sec.gov' ELSE '.example.org' END || '/d/' || doc_id AS url
  FROM documents
)"""
