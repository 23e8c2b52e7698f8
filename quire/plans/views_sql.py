"""The views of quire.sources.views as SQL common table expressions."""

from __future__ import annotations

V1 = """
v1n AS (SELECT event_id, event_type, user_id % 20 AS source_id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) - 1 AS n FROM events),
v1p AS (SELECT *, n // 200 + 1 AS shard_ord, n % 200 AS page_idx FROM v1n WHERE event_id % 13 <> 0),
v1 AS (SELECT source_id, shard_ord, page_idx, event_type, event_id,
  page_idx + CASE WHEN shard_ord = 1 AND page_idx < 10 + source_id % 5 THEN 1 ELSE 200 * (shard_ord - 1) - 9 - source_id % 5 END
  + CASE WHEN source_id % 4 = 3 AND page_idx >= 120 THEN 2 ELSE 0 END + CASE WHEN event_id % 61 = 0 THEN 500 ELSE 0 END AS printed FROM v1p)"""

V1M = (
    V1
    + """,
v1m AS (SELECT *, CASE WHEN event_type = 'view' THEN 'header' ELSE 'page_number' END AS kind FROM v1
  UNION ALL SELECT source_id, shard_ord, page_idx, event_type, event_id, printed + 1, 'header' FROM v1 WHERE event_id % 17 = 0)"""
)

V2 = """
v2l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
v2g AS (SELECT doc_id AS source_id, u.gid, u.text, (doc_id * 31 + u.gid * 7) % 20 AS k
  FROM v2l, LATERAL (SELECT unnest(ls) AS text, unnest(range(len(ls))) AS gid) u),
v2 AS (SELECT source_id, gid, gid // 40 + 1 AS shard_ord, (gid % 40) // 4 AS page_idx,
  CASE k WHEN 0 THEN 'header' WHEN 1 THEN 'footer' WHEN 2 THEN 'image' WHEN 3 THEN 'table' WHEN 4 THEN 'page_footnote' WHEN 5 THEN 'list' WHEN 6 THEN 'sidebar' ELSE 'text' END AS type,
  text, CASE WHEN length(text) <= 60 THEN 1 + gid % 2 END AS text_level FROM v2g)"""

V2R = (
    V2
    + """,
v2r AS (SELECT source_id, gid, shard_ord, page_idx, type, CASE WHEN type = 'table' AND gid % 3 <> 1 THEN '' ELSE text END AS text, text_level,
  CASE WHEN type = 'image' AND gid % 4 <> 3 THEN 'scan/images/' || gid || '.png' ELSE '' END AS img_path,
  CASE WHEN type = 'table' AND gid % 3 <> 1 THEN '<table><tr><td>' || text || '</td></tr></table>' ELSE '' END AS table_body,
  CASE WHEN type NOT IN ('image', 'table') OR gid % 3 = 2 THEN []::VARCHAR[] WHEN gid % 3 = 0 THEN ['Caption ' || gid] ELSE ['Caption ' || gid, 'and more'] END AS caption,
  CASE WHEN type IN ('image', 'table') AND gid % 2 = 0 THEN ['Note of ' || gid] ELSE []::VARCHAR[] END AS footnote FROM v2)"""
)

V3 = """
v3r AS (SELECT l_orderkey AS source_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
  1 + l_partkey % 4 AS level, l_suppkey % 7 AS t, l_partkey, l_suppkey, l_quantity FROM lineitem),
v3n AS (SELECT *, seq + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS number, seq * 3 + CASE WHEN l_suppkey % 9 = 0 THEN -4 ELSE 0 END AS page_idx FROM v3r),
v3z AS (SELECT *, CASE WHEN number < 10 THEN substr('零一二三四五六七八九', number + 1, 1) WHEN number = 10 THEN '十' ELSE '十' || substr('零一二三四五六七八九', number % 10 + 1, 1) END AS zh FROM v3n),
v3 AS (SELECT source_id, seq, level, CASE t WHEN 0 THEN '第' || zh || '部分' WHEN 1 THEN '第' || zh || '章' WHEN 2 THEN '第' || zh || '节' WHEN 3 THEN zh || '、'
  WHEN 4 THEN '（' || zh || '）' WHEN 5 THEN '（' || number || '）' ELSE number || '.' END AS title, number, page_idx, l_quantity::BIGINT AS chars, 1::BIGINT AS blocks, t AS tier_no FROM v3z)"""

V4 = """
v4 AS (SELECT doc_id AS source_id, quality, toxic FROM labels),
m_levels AS (SELECT source_id, source_id % 7 AS gid, (1 + quality)::BIGINT AS level FROM v4 WHERE toxic = 0),
m_deleted AS (SELECT source_id, source_id % 7 AS gid FROM v4 WHERE toxic = 1),
m_added AS (SELECT source_id, source_id % 5 AS gid, 'added ' || source_id AS title, 2::BIGINT AS level FROM v4 WHERE quality = 1 AND source_id % 3 = 0)"""

V5 = """
v5 AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS event_seq, event_type AS stage, user_id % 7 AS cursor_ FROM events)"""
