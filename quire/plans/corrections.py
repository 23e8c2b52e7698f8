"""Queries of corrections, previews, rounds of review, packs of evidence and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import audit, calibration, outline, reports, verify
from quire.operators import corrections as cor
from quire.plans.calibration import CONT
from quire.plans.outline import RTREE
from quire.plans.registry import query
from quire.plans.review import ALLF, G2, PG, _indexed, paged
from quire.plans.views_sql import V2
from quire.session import table
from quire.sources import views
from quire.tables import stored

ACTIONS = ("level", "level-clear", "add", "add-clear", "delete", "delete-clear", "anchor", "anchor-clear", "levels")

#: Plans of forty items a source over events, and what there was before.
ITEMS = f"""ci AS (SELECT event_id // 40 AS source_id, event_id AS item, list_extract([{', '.join(f"'{a}'" for a in ACTIONS)}], (1 + event_id % 9)::INTEGER) AS action,
  CASE WHEN event_id % 13 = 4 THEN 'add:' || (event_id % 5) ELSE '0' || (event_id % 6) END AS raw_key, event_id % 11 AS level, event_id % 5 AS gid_no,
  CASE WHEN event_id % 7 = 3 THEN 'x' ELSE '0' || (event_id % 5) END AS raw_gid, CASE WHEN event_id % 17 = 2 THEN ' ' ELSE 'title ' || event_id END AS title, event_id % 3 AS off_,
  event_id % 2 + 1 AS shard_ord, event_id % 4 AS page_idx, CASE WHEN event_id % 19 = 6 THEN NULL ELSE event_id % 50 END AS printed FROM events),
ck AS (SELECT *, CASE WHEN starts_with(raw_key, 'add:') THEN raw_key ELSE raw_key::BIGINT::VARCHAR END AS key FROM ci),
ce AS (SELECT *, CASE WHEN action IN ('level', 'levels') AND level NOT BETWEEN 1 AND 9 THEN 'level out of range'
    WHEN action = 'add' AND raw_gid = 'x' THEN 'no block number' WHEN action = 'add' AND trim(title) = '' THEN 'no title' WHEN action = 'add' AND level NOT BETWEEN 1 AND 9 THEN 'level out of range'
    WHEN action = 'anchor' AND printed IS NULL THEN 'no page' END AS error FROM ck),
cs AS (SELECT DISTINCT source_id FROM ci), cg AS (SELECT * FROM ce WHERE error IS NULL),
lv AS (SELECT source_id, key, arg_max(struct_pack(v := v), item).v AS v FROM (
    SELECT source_id, key, item, CASE WHEN action = 'level' THEN level END AS v FROM cg WHERE action IN ('level', 'level-clear', 'delete')
    UNION ALL SELECT source_id, u.k, item, u.v FROM cg, LATERAL (SELECT unnest(['0', '4']) AS k, unnest([2::BIGINT, level]) AS v) u WHERE action = 'levels') GROUP BY 1, 2),
dl AS (SELECT source_id, key, arg_max(action = 'delete', item) AS v FROM cg WHERE (action = 'delete' AND NOT starts_with(key, 'add:')) OR action = 'delete-clear' GROUP BY 1, 2),
ad AS (SELECT source_id, gid, arg_max(struct_pack(v := v), item).v AS v FROM (
    SELECT source_id, gid_no AS gid, item, CASE WHEN action = 'add' THEN trim(title) || '|' || level || '|' || off_ END AS v FROM cg WHERE action IN ('add', 'add-clear') AND raw_gid <> 'x'
    UNION ALL SELECT source_id, substr(key, 5)::BIGINT, item, NULL FROM cg WHERE action = 'delete' AND starts_with(key, 'add:')) GROUP BY 1, 2),
an AS (SELECT source_id, shard_ord, page_idx, arg_max(struct_pack(v := CASE WHEN action = 'anchor' THEN printed END), item).v AS v FROM cg WHERE action IN ('anchor', 'anchor-clear') GROUP BY 1, 2, 3)"""
AFTER = """SELECT 'level' AS kind, source_id, key, v::VARCHAR AS value FROM lv WHERE v IS NOT NULL
  UNION ALL SELECT 'level', source_id, '1', '3' FROM cs WHERE NOT EXISTS (SELECT 1 FROM lv WHERE lv.source_id = cs.source_id AND lv.key = '1')
  UNION ALL SELECT 'deleted', source_id, key, 'true' FROM dl WHERE v
  UNION ALL SELECT 'deleted', source_id, '2', 'true' FROM cs WHERE NOT EXISTS (SELECT 1 FROM dl WHERE dl.source_id = cs.source_id AND dl.key = '2')
  UNION ALL SELECT 'added', source_id, gid::VARCHAR, v FROM ad WHERE v IS NOT NULL
  UNION ALL SELECT 'added', source_id, '3', 'old|2|0' FROM cs WHERE NOT EXISTS (SELECT 1 FROM ad WHERE ad.source_id = cs.source_id AND ad.gid = 3)
  UNION ALL SELECT 'anchor', source_id, shard_ord || ':' || page_idx, v::VARCHAR FROM an WHERE v IS NOT NULL
  UNION ALL SELECT 'anchor', source_id, '1:0', '10' FROM cs WHERE NOT EXISTS (SELECT 1 FROM an WHERE an.source_id = cs.source_id AND an.shard_ord = 1 AND an.page_idx = 0)"""


def plan_items(spark, sf):
    """Items of plans with their fields as text."""
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), (1 + F.col("event_id") % 9).cast("int"))
    fields = F.map_from_arrays(
        F.array(*map(F.lit, ("key", "level", "pairs", "gid", "title", "offset", "shard", "page_idx", "printed"))),
        F.array(*[F.expr(x) for x in (
            "case when event_id % 13 = 4 then concat('add:', event_id % 5) else concat('0', event_id % 6) end", "cast(event_id % 11 as string)", "concat('{\"0\": 2, \"04\": ', event_id % 11, '}')",
            "case when event_id % 7 = 3 then 'x' else concat('0', event_id % 5) end", "case when event_id % 17 = 2 then ' ' else concat('title ', event_id) end", "cast(event_id % 3 as string)", "concat('P', event_id % 2 + 1)",
            "cast(event_id % 4 as string)", "case when event_id % 19 = 6 then null else cast(event_id % 50 as string) end",
        )]),
    )
    e = table(spark, sf, "events")
    return e.select(F.expr("event_id div 40").alias("source_id"), F.col("event_id").alias("item"), action.alias("action"), F.concat(F.lit("seen "), F.col("event_id")).alias("evidence"), fields.alias("fields"))


def before(items):
    """A correction of each kind for every source."""
    s = items.select("source_id").distinct()
    long = lambda v: F.lit(v).cast("long")
    return cor.Corrections(
        s.select("source_id", F.lit("1").alias("key"), long(3).alias("level")), s.select("source_id", F.lit("2").alias("key")), s.select("source_id", long(3).alias("gid"), F.lit("old").alias("title"), long(2).alias("level"), long(0).alias("offset")),
        s.select("source_id", long(1).alias("shard_ord"), long(0).alias("page_idx"), long(10).alias("printed")),
    )


def told(c):
    """Corrections of all kinds as rows (kind, source_id, key, value)."""
    rows = (("level", c.levels, F.col("key"), F.col("level")), ("deleted", c.deleted, F.col("key"), F.lit("true")), ("added", c.added, F.col("gid"), F.concat_ws("|", "title", "level", "offset")), ("anchor", c.anchors, F.concat_ws(":", "shard_ord", "page_idx"), F.col("printed")))
    return calibration.all_rows(*[t.select(F.lit(kind).alias("kind"), "source_id", key.cast("string").alias("key"), value.cast("string").alias("value")) for kind, t, key, value in rows])


@query("e07_applied_plans", f"WITH {ITEMS} {AFTER}")
def e07_applied(spark, sf):
    items = plan_items(spark, sf)
    return told(cor.applied(before(items), items)[0])


@query("e07_failed_items", f"WITH {ITEMS} SELECT source_id, item, action, error FROM ce WHERE error IS NOT NULL")
def e07_failed(spark, sf):
    items = plan_items(spark, sf)
    return cor.applied(before(items), items)[1]


ADDS = """aa AS (SELECT doc_id % 50 AS source_id, CASE WHEN doc_id % 9 = 1 THEN 'toc:' || doc_id ELSE '00' || doc_id END AS gid, CASE WHEN doc_id % 10 = 2 THEN ' ' ELSE ' t' || doc_id || ' ' END AS title, doc_id % 12 AS level, doc_id % 4 - 2 AS off_, doc_id FROM documents),
ae AS (SELECT *, CASE WHEN starts_with(gid, 'toc') THEN 'no block number' WHEN trim(title) = '' THEN 'no title' WHEN level NOT BETWEEN 1 AND 9 THEN 'level out of range' END AS error FROM aa)"""


def _additions(spark, sf):
    d = table(spark, sf, "documents")
    changes = d.selectExpr("doc_id % 50 as source_id", "case when doc_id % 9 = 1 then concat('toc:', doc_id) else concat('00', doc_id) end as gid", "case when doc_id % 10 = 2 then ' ' else concat(' t', doc_id, ' ') end as title", "doc_id % 12 as level", "doc_id % 4 - 2 as offset")
    old = d.selectExpr("doc_id % 50 as source_id", "doc_id + doc_id % 3 * 1000000 as gid", "'old' as title", "cast(1 as bigint) as level", "cast(0 as bigint) as offset")
    return cor.set_added(old, changes)


@query("e03_set_added", f"""WITH {ADDS}, new_ AS (SELECT source_id, doc_id AS gid, trim(title) AS title, level, greatest(0, off_) AS "offset" FROM ae WHERE error IS NULL)
SELECT * FROM new_ UNION ALL SELECT source_id, gid, 'old', 1, 0 FROM (SELECT doc_id % 50 AS source_id, doc_id + doc_id % 3 * 1000000 AS gid FROM documents) o
WHERE NOT EXISTS (SELECT 1 FROM new_ WHERE new_.source_id = o.source_id AND new_.gid = o.gid)""")
def e03(spark, sf):
    return _additions(spark, sf)[0]


@query("e03_refused_additions", f"WITH {ADDS} SELECT source_id, gid, error FROM ae WHERE error IS NOT NULL")
def e03_refused(spark, sf):
    return _additions(spark, sf)[1]


@query("e03_cleared_additions", "SELECT doc_id % 50 AS source_id, doc_id AS gid, 'old' AS title, 1::BIGINT AS level, 0::BIGINT AS \"offset\" FROM documents WHERE doc_id % 5 <> 0")
def e03_cleared(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id % 50 as source_id", "doc_id as gid", "'old' as title", "cast(1 as bigint) as level", "cast(0 as bigint) as offset")
    return cor.clear_added(d, d.filter("gid % 5 = 0"))


ANCHORS = "ol AS (SELECT doc_id % 20 AS source_id, 1 + doc_id % 3 AS shard_ord, doc_id AS page_idx, doc_id + 7 AS printed FROM documents)"


def _anchors(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id % 20 as source_id", "1 + doc_id % 3 as shard_ord", "doc_id as page_idx", "doc_id + 7 as printed")


@query("e05_set_anchors", f"""WITH {ANCHORS} SELECT source_id, shard_ord, page_idx, CASE WHEN page_idx % 4 = 0 THEN page_idx + 9 ELSE printed END AS printed FROM ol
  UNION ALL SELECT source_id, 9, page_idx, 1 FROM ol WHERE page_idx % 4 = 1""")
def e05_set(spark, sf):
    old = _anchors(spark, sf)
    new = old.filter("page_idx % 4 = 0").withColumn("printed", F.col("page_idx") + 9).unionByName(old.filter("page_idx % 4 = 1").withColumn("shard_ord", F.lit(9).cast("long")).withColumn("printed", F.lit(1).cast("long")))
    return cor.set_anchors(old, new)


@query("e05_cleared_anchors", f"WITH {ANCHORS} SELECT * FROM ol WHERE page_idx % 5 <> 0 AND NOT (source_id % 4 = 1 AND shard_ord = 2) AND source_id <> 7")
def e05_cleared(spark, sf):
    old = _anchors(spark, sf)
    pages = cor.clear_anchors(old, old.filter("page_idx % 5 = 0"))
    shards = cor.clear_anchors(pages, old.filter("source_id % 4 = 1 and shard_ord = 2").select("source_id", "shard_ord").distinct())
    return cor.clear_anchors(shards, old.filter("source_id = 7").select("source_id").distinct())


@query("e05_reset_with_backup", f"""WITH {ITEMS}, ol AS (SELECT u.* FROM cs, LATERAL (SELECT unnest(['level', 'deleted', 'added', 'anchor']) AS kind, cs.source_id AS source_id, unnest(['1', '2', '3', '1:0']) AS key, unnest(['3', 'true', 'old|2|0', '10']) AS value) u)
SELECT CASE WHEN source_id % 3 = 0 THEN 'backup' ELSE 'kept' END AS copy, * FROM ol""")
def e05_reset(spark, sf):
    old = before(plan_items(spark, sf))
    kept, backup = cor.reset(old, old.deleted.filter("source_id % 3 = 0"))
    return told(kept).withColumn("copy", F.lit("kept")).unionByName(told(backup).withColumn("copy", F.lit("backup")))


FIELDS = ("evidence", "gid", "key", "level", "offset", "page_idx", "pairs", "printed", "shard", "title")


@query("k09_revision_log", f"""WITH {ITEMS}, fl AS (SELECT *, array_to_string(list_filter([
    'gid=' || raw_gid, 'key=' || raw_key, 'level=' || level, 'offset=' || off_, 'page_idx=' || page_idx, 'pairs=' || '{{"0": 2, "04": ' || level || '}}', 'printed=' || printed, 'shard=P' || shard_ord, 'title=' || title], lambda x: x IS NOT NULL), '　') AS told
  FROM ce),
ll AS (SELECT *, CASE WHEN error IS NULL THEN '- `' || action || '` ' || told || chr(10) || '    - 依据：seen ' || item ELSE '- ❌ items[' || item || '] ' || action || '：' || error END AS line FROM fl),
lg AS (SELECT source_id, count(*) FILTER (error IS NULL) AS applied, count(*) FILTER (error IS NOT NULL) AS failed, bool_or(error IS NULL AND action IN ('anchor', 'anchor-clear')) AS needs_pagecal,
  string_agg(line, chr(10) ORDER BY error IS NOT NULL, item) AS lines FROM ll GROUP BY 1)
SELECT source_id, applied, failed, needs_pagecal, '## day ' || source_id || '　' || CASE WHEN source_id % 2 = 0 THEN '（未命名）' ELSE 'plan ' || source_id END || '　应用 ' || applied || ' 条' || CASE WHEN failed > 0 THEN '，失败 ' || failed || ' 条' ELSE '' END
  || chr(10) || chr(10) || CASE WHEN source_id % 3 = 0 THEN '- 说明：why' || chr(10) ELSE '' END || lines || chr(10) AS log FROM lg""")
def k09(spark, sf):
    items = plan_items(spark, sf)
    _, failed = cor.applied(before(items), items)
    plans = items.select("source_id").distinct().selectExpr("source_id", "concat('day ', source_id) as at", "case when source_id % 2 = 0 then '' else concat('plan ', source_id) end as name", "case when source_id % 3 = 0 then 'why' end as note")
    return cor.revision_log(plans, items, failed).select("source_id", "applied", "failed", "needs_pagecal", "log")


PREVIEW = f"""{ITEMS}, fl AS (SELECT source_id, item, action, item || chr(31) || action || chr(31) || array_to_string(list_filter([
    'gid=' || raw_gid, 'key=' || raw_key, 'level=' || level, 'offset=' || off_, 'page_idx=' || page_idx, 'pairs=' || '{{"0": 2, "04": ' || level || '}}', CASE WHEN printed IS NULL THEN 'printed' ELSE 'printed=' || printed END,
    'shard=P' || shard_ord, 'title=' || title], lambda x: x IS NOT NULL), chr(30)) AS r FROM ck WHERE source_id % 5 <> 4),
po AS (SELECT source_id, count(*) AS operations, string_agg(r, chr(10) ORDER BY item) AS told FROM fl GROUP BY 1),
pv AS (SELECT cs.source_id, 'r' || cs.source_id AS base_revision, left(sha256(cs.source_id || chr(10) || 'r' || cs.source_id || chr(10) || coalesce(told, '')), 24) AS preview_id, coalesce(operations, 0) AS operations,
  CASE WHEN cs.source_id % 7 = 1 THEN 1 ELSE 0 END::BIGINT AS errors FROM cs LEFT JOIN po USING (source_id)),
ps AS (SELECT source_id, preview_id, CASE WHEN source_id % 11 = 3 THEN 'applied' WHEN errors > 0 THEN 'errors' WHEN source_id % 6 = 2 THEN 'stale' WHEN operations = 0 THEN 'nothing' ELSE 'ready' END AS state FROM pv)"""


def _previews(spark, sf):
    items = plan_items(spark, sf)
    sources = items.select("source_id").distinct().withColumn("revision", F.concat(F.lit("r"), F.col("source_id")))
    made = cor.previews(sources, items.filter("source_id % 5 <> 4"), sources.filter("source_id % 7 = 1").select("source_id", F.lit("e").alias("error")))
    now = sources.withColumn("revision", F.when(F.col("source_id") % 6 == 2, "changed").otherwise(F.col("revision")))
    return items, made, cor.preview_states(made, now, made.filter("source_id % 11 = 3"))


@query("e14_previews", f"WITH {PREVIEW} SELECT * FROM pv")
def e14_previews(spark, sf):
    return _previews(spark, sf)[1]


@query("e14_preview_states", f"WITH {PREVIEW} SELECT * FROM ps")
def e14_states(spark, sf):
    return _previews(spark, sf)[2]


@query("e14_outcomes", f"""WITH {PREVIEW} SELECT source_id, CASE WHEN state <> 'ready' THEN state WHEN EXISTS (SELECT 1 FROM ce WHERE ce.source_id = ps.source_id AND error IS NOT NULL AND item % 40 > 20) THEN 'rolled back' ELSE 'applied now' END AS outcome FROM ps""")
def e14_outcomes(spark, sf):
    items, _, states = _previews(spark, sf)
    items = items.filter("item % 40 > 20")
    return cor.apply_previews(before(items), items, states)[1]


@query("e14_previews_applied", f"""WITH {PREVIEW}, bad AS (SELECT DISTINCT source_id FROM ce WHERE error IS NOT NULL AND item % 40 > 36),
now_ AS (SELECT source_id FROM ps WHERE state = 'ready' AND source_id NOT IN (SELECT source_id FROM bad)),
lw AS (SELECT source_id, key, arg_max(struct_pack(v := v), item).v AS v FROM (
    SELECT source_id, key, item, CASE WHEN action = 'level' THEN level END AS v FROM cg WHERE action IN ('level', 'level-clear', 'delete') AND item % 40 > 36
   
  UNION ALL SELECT source_id, u.k, item, u.v
  FROM cg, LATERAL (SELECT unnest(['0', '4']) AS k, unnest([2::BIGINT, level]) AS v) u WHERE action = 'levels' AND item % 40 > 36) WHERE source_id IN (SELECT source_id
  FROM now_) GROUP BY 1, 2)
SELECT source_id, key, v AS level FROM lw WHERE v IS NOT NULL UNION ALL SELECT source_id, '1', 3 FROM cs WHERE NOT EXISTS (SELECT 1 FROM lw WHERE lw.source_id = cs.source_id AND lw.key = '1')""")
def e14_applied(spark, sf):
    items, _, states = _previews(spark, sf)
    old = before(items)
    return cor.apply_previews(old, items.filter("item % 40 > 36"), states)[0].levels


ROUNDS = """rv AS (SELECT event_id AS job_id, list_extract(['needs_ai_review', 'needs_review', 'needs_ai_review', 'reviewed'], (1 + event_id % 4)::INTEGER) AS stage, event_id % 3 AS rounds, event_id % 10 <> 7 AS fresh,
  CASE WHEN event_id % 5 < 2 THEN 0 ELSE event_id % 5 END AS operations, CASE WHEN event_id % 7 < 4 THEN 0 ELSE 1 END AS anchors, CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END AS without_evidence, CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS without_scope,
  CASE WHEN event_id % 31 = 0 THEN 2 ELSE 0 END AS errors, event_id % 6 <> 5 AS apply, event_id % 2 = 0 AS complete, CASE WHEN event_id % 8 = 2 THEN ' ' ELSE 'all read' END AS note, CASE WHEN event_id % 9 = 4 THEN 3 ELSE 0 END AS unresolved, CASE WHEN event_id % 16 = 6 THEN 2 ELSE 0 END AS unread
  FROM events),
ro AS (SELECT *, operations + anchors AS changes, complete AND operations + anchors = 0 AND unresolved = 0 AS clean FROM rv),
rr AS (SELECT *, CASE WHEN stage = 'reviewed' THEN 'wrong stage' WHEN NOT fresh THEN 'stale' WHEN rounds >= 2 AND changes > 0 THEN 'no rounds left' WHEN without_evidence > 0 THEN 'no evidence' WHEN without_scope > 0 THEN 'no scope evidence'
  WHEN errors > 0 THEN 'errors' WHEN NOT apply THEN 'dry run' WHEN complete AND trim(note) = '' THEN 'no review note' WHEN anchors > 0 AND operations > 0 THEN 'anchors applied, read again'
  WHEN clean AND unread > 0 THEN 'unread nodes' WHEN clean THEN 'reviewed' WHEN changes > 0 THEN 'applied' ELSE 'noted' END AS outcome FROM ro)"""


@query("e16_review_rounds", f"""WITH {ROUNDS} SELECT job_id, outcome,
  CASE WHEN outcome = 'reviewed' THEN 'reviewed' WHEN outcome IN ('applied', 'noted') AND unresolved > 0 THEN 'needs_review' WHEN outcome IN ('applied', 'noted', 'anchors applied, read again') THEN 'needs_ai_review' ELSE stage END AS stage,
  rounds + CASE WHEN outcome IN ('applied', 'anchors applied, read again') THEN 1 ELSE 0 END AS rounds FROM rr""")
def e16(spark, sf):
    e = table(spark, sf, "events")
    jobs = e.selectExpr("event_id as job_id", "element_at(array('needs_ai_review', 'needs_review', 'needs_ai_review', 'reviewed'), cast(1 + event_id % 4 as int)) as stage", "'r1' as revision", "event_id % 3 as rounds")
    replies = e.selectExpr(
        "event_id as job_id", "case when event_id % 10 <> 7 then 'r1' else 'r0' end as base_revision", "case when event_id % 5 < 2 then 0 else event_id % 5 end as operations", "case when event_id % 7 < 4 then 0 else 1 end as anchors",
        "case when event_id % 23 = 0 then 1 else 0 end as without_evidence", "case when event_id % 29 = 0 then 1 else 0 end as without_scope", "case when event_id % 31 = 0 then 2 else 0 end as errors", "event_id % 6 <> 5 as apply", "event_id % 2 = 0 as complete",
        "case when event_id % 8 = 2 then ' ' else 'all read' end as review_note", "case when event_id % 9 = 4 then 3 else 0 end as unresolved", "case when event_id % 16 = 6 then 2 else 0 end as unread",
    )
    return cor.review_rounds(jobs, replies)


PACK_LIMIT = 3000


def _pack_sql(step: int) -> str:
    parts = ", ".join(f"{n} := {n}[1:{m[step]}]" for n, m in cor.PART_LIMITS.items() if n in ("windows", "starts", "observations"))
    return f"to_json(struct_pack(source_id := source_id, nodes := nodes, {parts}))"


@query("e10_evidence_packs", f"""WITH {V2}, ls AS (SELECT source_id, coalesce(list(text ORDER BY gid) FILTER (text_level IS NOT NULL), []::VARCHAR[]) AS nodes, coalesce(list('window ' || gid ORDER BY gid) FILTER (gid % 2 = 0), []::VARCHAR[]) AS windows,
  list('start ' || gid ORDER BY gid) AS starts, coalesce(list('seen ' || page_idx ORDER BY gid) FILTER (type = 'header'), []::VARCHAR[]) AS observations FROM v2 GROUP BY 1),
p AS (SELECT source_id, {_pack_sql(0)}::VARCHAR AS a, {_pack_sql(1)}::VARCHAR AS b, {_pack_sql(2)}::VARCHAR AS c FROM ls),
st AS (SELECT *, CASE WHEN length(a) <= {PACK_LIMIT} THEN 0 WHEN length(b) <= {PACK_LIMIT} THEN 1 WHEN length(c) <= {PACK_LIMIT} THEN 2 ELSE 3 END AS step FROM p)
SELECT source_id, step, CASE step WHEN 0 THEN length(a) WHEN 1 THEN length(b) ELSE length(c) END::BIGINT AS chars, sha256(CASE step WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c END) AS digest FROM st""")
def e10(spark, sf):
    b = views.blocks(spark, sf)
    part = lambda rows, value: rows.select("source_id", F.col("gid").alias("ord"), value.alias("value"))
    parts = {"windows": part(b.filter("gid % 2 = 0"), F.concat(F.lit("window "), F.col("gid"))), "starts": part(b, F.concat(F.lit("start "), F.col("gid"))), "observations": part(b.filter("type = 'header'"), F.concat(F.lit("seen "), F.col("page_idx")))}
    packs = cor.evidence_packs(b, part(b.filter("text_level is not null"), F.col("text")), parts, PACK_LIMIT)
    return packs.select("source_id", "step", "chars", F.sha2("pack", 256).alias("digest"))


# --- reports ---------------------------------------------------------------------------

SEG_LINE = """'| P' || shard_ord || ' | ' || kind || ' | ' || page_start || '–' || page_end || ' | ' || printed_start || '–' || printed_end || ' | ' || CASE WHEN "offset" >= 0 THEN '+' ELSE '' END || "offset" || ' | ' || n_obs || ' | ' || round_even(coverage * 100, 0)::INTEGER || '% | ' || confidence || ' |'"""
TABLE_HEAD = "'| 分片 | 类型 | 物理页 range | 纸书页 range | offset | 观测 | 覆盖 | 置信 |' || chr(10) || '| --- | --- | --- | --- | --- | --- | --- | --- |'"


@query("k08_calibration_reports", f"""{CONT},
vs AS (SELECT source_id, coalesce(sum(n_obs) FILTER (kind = 'body'), 0) AS o, coalesce(sum(span) FILTER (kind = 'body'), 0) AS s FROM kn GROUP BY 1),
vb AS (SELECT vs.source_id, o < 5 OR (CASE WHEN s > 0 THEN round_even(o / s, 3) ELSE 0 END) < 0.6 AS weak, coalesce((SELECT count(*)
  FROM ct WHERE ct.source_id = vs.source_id AND NOT ok), 0) AS breaks FROM vs),
gp AS (SELECT source_id, shard_ord, lag(page_end) OVER w AS after_page, page_start AS before_page FROM kn WINDOW w AS (PARTITION BY source_id, shard_ord ORDER BY page_start, seg_ord)),
pf AS (SELECT source_id, shard_ord, page_idx, arg_min(printed, event_id) FILTER (kind = 'page_number') AS p, arg_min(printed, event_id) FILTER (kind = 'header') AS h FROM v1m GROUP BY 1, 2, 3),
ls AS (SELECT source_id, '# 页码校准报告' || chr(10) || chr(10) || '- 判定：**' || CASE WHEN weak THEN 'degraded' WHEN breaks > 0 THEN 'needs_review' ELSE 'calibrated' END || '** ／ locator_type = `' || CASE WHEN weak THEN 'section_only' ELSE 'paginated' END || '`'
    || chr(10) || chr(10) || '## 区间表' || chr(10) || chr(10) || {TABLE_HEAD} AS line, 0 AS part, 0 AS a, 0 AS b FROM vb
  UNION ALL SELECT source_id, {SEG_LINE}, 1, shard_ord, page_start FROM kn
  UNION ALL SELECT DISTINCT source_id, chr(10) || '## 断点（不填、不外推）' || chr(10), 2, 0, 0 FROM gp WHERE before_page - after_page > 1
 
  UNION ALL SELECT source_id, '- P' || shard_ord || ' 物理页 ' || after_page || '→' || before_page || ' 之间漏 ' || (before_page - after_page - 1) || ' 页', 3, shard_ord, after_page
  FROM gp WHERE before_page - after_page > 1
  UNION ALL SELECT DISTINCT source_id, chr(10) || '## 跨分片接续' || chr(10) || chr(10) || '| 从 | 到 | 期望 | 实际 | 结论 |' || chr(10) || '| --- | --- | --- | --- | --- |', 4, 0, 0 FROM ct
 
  UNION ALL
  SELECT source_id, '| P' || prev_shard || ' | P' || shard_ord || ' | ' || expected || ' | ' || next_printed || ' | ' || CASE WHEN ok THEN '✅' ELSE '⚠️' END || ' ' || note || ' |', 5, shard_ord, page_start
  FROM ct
  UNION ALL SELECT DISTINCT source_id, chr(10) || '## 页眉与页码冲突（已以 page_number 为准）' || chr(10), 6, 0, 0 FROM pf WHERE p <> h
  UNION ALL SELECT source_id, '- P' || shard_ord || ' 物理页 ' || page_idx || '：page_number=' || p || '，header=' || h, 7, shard_ord, page_idx FROM pf WHERE p <> h)
SELECT source_id, string_agg(line, chr(10) ORDER BY part, a, b, line) AS report FROM ls GROUP BY 1""")
def k08_calibration(spark, sf):
    obs = views.mixed_observations(spark, sf)
    segs = calibration.calibrated(obs)
    checks = calibration.continuity(segs)
    conflicts = calibration.header_conflicts(calibration.first_on_page(obs, "event_id"))
    return reports.calibration_report(calibration.verdict(segs, checks), segs, calibration.gaps(segs), checks, conflicts)


@query("k08_outline_reports", f"""{RTREE}, dp AS (SELECT source_id, seq, title, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS k, count(*) OVER (PARTITION BY source_id) AS n FROM tr WHERE seq % 3 = 1),
ls AS (SELECT source_id, '# 目录索引：' || source_id || chr(10) || '- 节点总数：' || count(*) || chr(10) || chr(10) || '## 层级统计（选切分深度用）' || chr(10) || chr(10)
    || '| 层级 | 节点数 | 若切到本层=文件数 | 总字数 | 平均字数 | 最小 | 最大 | 空节点 |' || chr(10) || '| --- | --- | --- | --- | --- | --- | --- | --- |' AS line, 0 AS part, 0 AS a FROM tr GROUP BY 1
 
  UNION ALL
  SELECT source_id, '| L' || level || ' | ' || count(*) || ' | **' || count(*) || '** | ' || sum(chars)::BIGINT || ' | ' || floor(sum(chars) / count(*))::BIGINT || ' | ' || min(chars) || ' | ' || max(chars) || ' | ' || count(*) FILTER (blocks = 0) || ' |', 1, level
  FROM tr GROUP BY source_id, level
  UNION ALL SELECT DISTINCT source_id, chr(10) || '## 目录树' || chr(10), 2, 0 FROM tr
  UNION ALL SELECT source_id, repeat('    ', (depth - 1)::INTEGER) || '- `' || nid || '` **' || title || '** 〔chapter｜P1p' || page_idx || '｜' || chars || '字｜' || blocks || '块〕', 3, seq FROM tr
  UNION ALL SELECT DISTINCT source_id, chr(10) || '## 被丢弃的候选标题' || chr(10) || chr(10) || '| 分片 | 物理页 | 文本 | 原因 |' || chr(10) || '| --- | --- | --- | --- |', 4, 0 FROM dp
  UNION ALL SELECT source_id, '| P1 | ' || seq || ' | ' || left(title, 50) || ' | noise |', 5, k FROM dp WHERE k <= 80
  UNION ALL SELECT DISTINCT source_id, chr(10) || '（共 ' || n || ' 条）', 6, 0 FROM dp)
SELECT source_id, string_agg(line, chr(10) ORDER BY part, a, line) AS report FROM ls GROUP BY 1""")
def k08_outline(spark, sf):
    nodes = views.outline(spark, sf)
    t = outline.with_parents(nodes).withColumns({"marker": F.lit("chapter"), "shard_ord": F.lit(1)})
    dropped = nodes.withColumn("shard_ord", F.lit(1)).filter("seq % 3 = 1").select("source_id", F.col("seq").alias("gid"), "shard_ord", F.col("seq").alias("page_idx"), F.col("title").alias("text"), F.lit("noise").alias("drop_reason"))
    return reports.outline_report(t, outline.level_stats(nodes), dropped)


@query("k08_audit_reports", f"""{RTREE}, {PG}, af AS ({ALLF}), sm AS (SELECT source_id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'warn') AS warn, count(*) FILTER (severity = 'info') AS info FROM af GROUP BY 1),
fi AS (SELECT *, upper(left("check", 4)) || '-' || lpad(row_number() OVER (PARTITION BY source_id ORDER BY "check", seq)::VARCHAR, 3, '0') AS id FROM af),
fo AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, id) AS place FROM fi),
sv AS (SELECT unnest(['high', 'warn', 'info']) AS s, unnest([0, 1, 2]) AS k, unnest(['🔴 必须处理', '🟡 建议核对', '⚪ 现状记录']) AS t),
ls AS (SELECT source_id, '# 目录校核：' || source_id || chr(10) || '- 判定：**' || CASE WHEN high > 0 THEN 'fail' WHEN warn > 0 THEN 'warn' ELSE 'pass' END || '** ｜ 🔴 ' || high || ' 🟡 ' || warn || ' ⚪ ' || info AS line, 0 AS part, 0 AS a
  FROM sm
  UNION ALL SELECT source_id, chr(10) || '## ' || t || '（' || CASE s WHEN 'high' THEN high WHEN 'warn' THEN warn ELSE info END || '）', 10 * k + 2, 0 FROM sm, sv
  UNION ALL SELECT source_id, '- ✅ 无', 10 * k + 3, 0 FROM sm, sv WHERE CASE s WHEN 'high' THEN high WHEN 'warn' THEN warn ELSE info END = 0
 
  UNION ALL SELECT source_id, '- **' || id || '** `' || "check" || '`' || CASE WHEN coalesce(detail, '') <> '' THEN chr(10) || '    - ' || detail ELSE '' END, 10 * k + 4, place
  FROM fo JOIN sv ON s = severity)
SELECT source_id, string_agg(line, chr(10) ORDER BY part, a, line) AS report FROM ls GROUP BY 1""")
def k08_audit(spark, sf):
    f = audit.page_findings(paged(spark, sf))
    return reports.audit_report(audit.summary(f), audit.ordered_ids(f))


@query("k08_verify_reports", f"""{G2}, gt AS (SELECT source_id, 'G2' AS gate, '内容无损' AS name, CASE WHEN missing = 0 THEN 'pass' WHEN 1 - missing / blocks >= 0.99 THEN 'warn' ELSE 'fail' END AS status, missing || '/' || blocks AS note FROM g2
  UNION ALL SELECT source_id, 'G3', '页码一致性', CASE WHEN source_id % 4 = 0 THEN 'warn' WHEN source_id % 9 = 1 THEN 'skip' ELSE 'pass' END, NULL FROM (SELECT DISTINCT source_id FROM v2)),
vd AS (SELECT source_id, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS verdict FROM gt GROUP BY 1),
mz AS (SELECT unnest(['pass', 'warn', 'fail', 'skip']) AS s, unnest(['✅', '⚠️', '❌', '➖']) AS m),
ls AS (SELECT source_id, '# 校验报告：' || source_id || chr(10) || '- 总判定：**' || m || ' ' || verdict || '**' || chr(10) || chr(10) || '| 闸门 | 名称 | 结果 | 说明 |' || chr(10) || '| --- | --- | --- | --- |' AS line, '' AS gate
  FROM vd JOIN mz ON s = verdict
  UNION ALL SELECT source_id, '| ' || gate || ' | ' || name || ' | ' || m || ' ' || status || ' | ' || coalesce(note, '') || ' |', gate FROM gt JOIN mz ON s = status)
SELECT source_id, string_agg(line, chr(10) ORDER BY gate) AS report FROM ls GROUP BY 1""")
def k08_verify(spark, sf):
    note = F.concat_ws("/", "missing", "blocks")
    one = verify.lossless(*_indexed(spark, sf)).select("source_id", F.lit("G2").alias("gate"), F.lit("内容无损").alias("name"), "status", note.alias("note"))
    status = F.expr("case when source_id % 4 = 0 then 'warn' when source_id % 9 = 1 then 'skip' else 'pass' end")
    other = table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("source_id")).distinct().select("source_id", F.lit("G3").alias("gate"), F.lit("页码一致性").alias("name"), status.alias("status"), F.lit(None).cast("string").alias("note"))
    gates = stored(one.unionByName(other), "gates")
    return reports.verify_report(verify.overall(gates), gates)
