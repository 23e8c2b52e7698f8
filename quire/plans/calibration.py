"""Queries of printed-page calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import calibration as cal
from quire.plans.registry import query
from quire.plans.views_sql import V1, V1M
from quire.sources import views

L = "bigint"


def _flat(df):
    return df.withColumn("basis_pages", F.array_join(F.col("basis_pages").cast("array<string>"), ",")) if "basis_pages" in df.columns else df


def _segments_sql(src: str, second: str, is_number: str) -> str:
    return f"""
so AS (SELECT *, {second} AS second FROM {src}),
sl AS (SELECT *, lag(page_idx) OVER w AS pp, lag(printed) OVER w AS pn FROM so WINDOW w AS (PARTITION BY source_id, shard_ord ORDER BY page_idx, second, printed)),
sf AS (SELECT *, CASE WHEN printed - page_idx = pn - pp AND printed > pn AND page_idx > pp THEN 0 ELSE 1 END AS opens FROM sl),
si AS (SELECT *, sum(opens) OVER (PARTITION BY source_id, shard_ord ORDER BY page_idx, second, printed ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS seg_ord FROM sf),
sg AS (SELECT source_id, shard_ord, seg_ord, min(page_idx) AS page_start, max(page_idx) AS page_end, min(printed) AS printed_start, max(printed) AS printed_end, count(*) AS n_obs,
  coalesce(string_agg(CASE WHEN {is_number} THEN page_idx::VARCHAR END, ',' ORDER BY page_idx), '') AS basis_pages FROM si GROUP BY 1, 2, 3),
seg AS (SELECT *, printed_start - page_start AS "offset", page_end - page_start + 1 AS span, round_even(n_obs / (page_end - page_start + 1), 3) AS coverage,
  CASE WHEN n_obs >= 3 AND n_obs / (page_end - page_start + 1) >= 0.75 THEN 'high' WHEN n_obs >= 2 AND n_obs / (page_end - page_start + 1) >= 0.5 THEN 'medium' ELSE 'low' END AS confidence,
  page_end - page_start + 1 > n_obs AS derived FROM sg)"""


SEG = f"WITH {V1}, {_segments_sql('v1', '0', 'true')}"
SEGM = f"""WITH {V1M}, {_segments_sql('v1m', "CASE WHEN kind = 'page_number' THEN 0 ELSE 1 END", "kind = 'page_number'")}"""

EXT = f"""{SEGM},
hd AS (SELECT source_id, shard_ord, printed - page_idx AS "offset", list(page_idx ORDER BY page_idx) AS pages FROM v1m WHERE kind = 'header' GROUP BY ALL),
ex0 AS (SELECT s.*, coalesce(h.pages, []::BIGINT[]) AS pages FROM seg s LEFT JOIN hd h USING (source_id, shard_ord, "offset")),
ex1 AS (SELECT * EXCLUDE (pages, page_start, page_end), page_start AS ps, coalesce(list_min(list_filter(pages, lambda p: p >= page_start - 12 AND p < page_start)), page_start) AS page_start,
  list_reduce(list_concat([page_end], pages), lambda e, p: CASE WHEN p > e AND p <= e + 12 THEN p ELSE e END) AS page_end FROM ex0),
ext AS (SELECT source_id, shard_ord, seg_ord, page_start, page_end, page_start + "offset" AS printed_start, page_end + "offset" AS printed_end, n_obs, "offset", page_end - page_start + 1 AS span,
  round_even(n_obs / (page_end - page_start + 1), 3) AS coverage, confidence FROM ex1)"""

ABS = f"""{EXT},
ab0 AS (SELECT *, first_value("offset") OVER (PARTITION BY source_id, shard_ord ORDER BY n_obs DESC, span, page_start, seg_ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS main,
  count(*) OVER (PARTITION BY source_id, shard_ord) AS of_ FROM ext),
ab1 AS (SELECT *, last_value(CASE WHEN "offset" = main THEN seg_ord END IGNORE NULLS) OVER (PARTITION BY source_id, shard_ord ORDER BY page_start, seg_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm,
  first_value(CASE WHEN "offset" = main THEN seg_ord END IGNORE NULLS) OVER (PARTITION BY source_id, shard_ord ORDER BY page_start, seg_ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nm
  FROM ab0),
ab AS (SELECT *, of_ >= 3 AND span <= 2 AND "offset" <> main AND pm IS NOT NULL AND nm IS NOT NULL AS absorbed FROM ab1),
rc AS (SELECT source_id, shard_ord, pm AS seg_ord, max(page_end) AS reach FROM ab WHERE absorbed GROUP BY 1, 2, 3),
kp AS (SELECT a.source_id, a.shard_ord, a.seg_ord, a.page_start, greatest(a.page_end, coalesce(r.reach, a.page_end)) AS page_end, a.printed_start, a.n_obs, a."offset", a.confidence, a.printed_end AS pe0, a.coverage AS c0, r.reach
  FROM ab a LEFT JOIN rc r USING (source_id, shard_ord, seg_ord) WHERE NOT a.absorbed),
kept AS (SELECT source_id, shard_ord, seg_ord, page_start, page_end, printed_start, CASE WHEN reach IS NULL THEN pe0 ELSE page_end + "offset" END AS printed_end, n_obs, "offset", page_end - page_start + 1 AS span,
  CASE WHEN reach IS NULL THEN c0 ELSE round_even(n_obs / (page_end - page_start + 1), 3) END AS coverage, confidence FROM kp)"""

KIND = f"""{ABS},
kn AS (SELECT *, CASE WHEN page_end < first_value(page_start) OVER (PARTITION BY source_id, shard_ord ORDER BY span DESC, n_obs DESC, page_start, seg_ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) THEN 'front' ELSE 'body' END AS kind FROM kept)"""

CONT = f"""{KIND},
bd AS (SELECT *, lag(shard_ord) OVER w AS prev_shard, lag(page_end) OVER w AS prev_end, lag(printed_end) OVER w AS prev_printed
  FROM kn WHERE kind = 'body' WINDOW w AS (PARTITION BY source_id ORDER BY shard_ord, page_start, seg_ord)),
ct AS (SELECT source_id, prev_shard, prev_end, shard_ord, page_start, prev_printed, printed_start AS next_printed, prev_printed + 1 AS expected, printed_start >= prev_printed + 1 AS ok,
  CASE WHEN printed_start = prev_printed + 1 THEN 'continues' WHEN printed_start > prev_printed + 1 THEN 'gap' ELSE 'backwards' END AS note FROM bd WHERE prev_printed IS NOT NULL)"""

PAGES = f"""{KIND},
pg AS (SELECT k.*, u.page_idx, u.page_idx + k."offset" AS printed FROM kn k, LATERAL (SELECT unnest(range(k.page_start, k.page_end + 1)) AS page_idx) u),
f1 AS (SELECT DISTINCT ON (source_id, shard_ord, page_idx) source_id, shard_ord, page_idx, kind, printed, page_start FROM pg ORDER BY source_id, shard_ord, page_idx, page_start, seg_ord),
fr AS (SELECT source_id, printed, count(*) AS fronts FROM pg WHERE kind = 'front' GROUP BY 1, 2),
ap AS (SELECT DISTINCT source_id, shard_ord, page_idx FROM v1p),
lc AS (SELECT a.source_id, a.shard_ord, a.page_idx, CASE WHEN f1.kind = 'front' THEN CASE WHEN fr.fronts > 1 THEN 'front-' || f1.printed || '-P' || a.shard_ord || '-s' || f1.page_start ELSE 'front-' || f1.printed END ELSE f1.printed::VARCHAR END AS locator
  FROM ap a LEFT JOIN f1 USING (source_id, shard_ord, page_idx) LEFT JOIN fr ON fr.source_id = a.source_id AND fr.printed = f1.printed)"""

COLS = ("source_id", "shard_ord", "seg_ord", "page_start", "page_end", "printed_start", "printed_end", "n_obs", "offset", "span", "coverage", "confidence")
COLS_SQL = 'source_id, shard_ord, seg_ord, page_start, page_end, printed_start, printed_end, n_obs, "offset", span, coverage, confidence'


@query("w01_segments", f"{SEG} SELECT {COLS_SQL}, derived, basis_pages FROM seg")
def w01(spark, sf):
    return _flat(cal.segments(views.page_observations(spark, sf))).select(*COLS, "derived", "basis_pages")


@query("w01_mixed_segments", f"{SEGM} SELECT {COLS_SQL}, derived, basis_pages FROM seg")
def w01_mixed(spark, sf):
    return _flat(cal.segments(views.mixed_observations(spark, sf))).select(*COLS, "derived", "basis_pages")


@query("a07_segment_stats", f"{SEG} SELECT confidence, derived, count(*) AS segments, sum(n_obs)::BIGINT AS n_obs, sum(span)::BIGINT AS pages, max(span) AS longest FROM seg GROUP BY 1, 2")
def a07(spark, sf):
    s = cal.segments(views.page_observations(spark, sf))
    return s.groupBy("confidence", "derived").agg(F.count("*").alias("segments"), F.sum("n_obs").alias("n_obs"), F.sum("span").alias("pages"), F.max("span").alias("longest"))


FIRST = f"""WITH {V1M}, fo AS (SELECT source_id, shard_ord, page_idx, kind, min(printed) AS printed FROM v1m GROUP BY ALL)"""


@query("w02_first_on_page", f"{FIRST} SELECT * FROM fo")
def w02(spark, sf):
    return cal.first_on_page(views.mixed_observations(spark, sf), "printed")


@query("j03_header_conflicts", f"""{FIRST} SELECT p.source_id, p.shard_ord, p.page_idx, p.printed AS page_number, h.printed AS header
  FROM fo p JOIN fo h USING (source_id, shard_ord, page_idx) WHERE p.kind = 'page_number' AND h.kind = 'header' AND p.printed <> h.printed""")
def j03(spark, sf):
    return cal.header_conflicts(cal.first_on_page(views.mixed_observations(spark, sf), "printed"))


def _extended(spark, sf):
    obs = views.mixed_observations(spark, sf)
    return cal.extend_with_headers(cal.segments(obs), obs)


def _calibrated(spark, sf):
    return cal.calibrated(views.mixed_observations(spark, sf))


@query("w03_extend_with_headers", f"{EXT} SELECT {COLS_SQL} FROM ext")
def w03(spark, sf):
    return _extended(spark, sf).select(*COLS)


@query("w04_absorb_outliers", f"{ABS} SELECT {COLS_SQL} FROM kept")
def w04(spark, sf):
    return cal.absorb_outliers(_extended(spark, sf))[0].select(*COLS)


@query("w04_absorbed_pages", f'{ABS} SELECT source_id, shard_ord, page_start AS page_idx, printed_start AS observed, page_start + main AS expected FROM ab WHERE absorbed')
def w04_pages(spark, sf):
    return cal.absorb_outliers(_extended(spark, sf))[1]


@query("w05_segment_kinds", f"{KIND} SELECT {COLS_SQL}, kind FROM kn")
def w05(spark, sf):
    return _calibrated(spark, sf).select(*COLS, "kind")


@query("w06_continuity", f"{CONT} SELECT * FROM ct")
def w06(spark, sf):
    return cal.continuity(_calibrated(spark, sf))


@query("w07_gaps", f"""{KIND}, gl AS (SELECT *, lag(page_end) OVER w AS after_page, lag(printed_end) OVER w AS pe FROM kn WINDOW w AS (PARTITION BY source_id, shard_ord ORDER BY page_start, seg_ord))
SELECT source_id, shard_ord, after_page, page_start AS before_page, page_start - after_page - 1 AS n_unmapped, array_to_string(range(pe + 1, pe + page_start - after_page), ',') AS missing_printed FROM gl WHERE page_start - after_page > 1""")
def w07(spark, sf):
    return cal.gaps(_calibrated(spark, sf)).withColumn("missing_printed", F.array_join(F.col("missing_printed").cast("array<string>"), ","))


@query("a08_verdict", f"""{CONT}, bs AS (SELECT source_id, coalesce(sum(n_obs) FILTER (kind = 'body'), 0)::BIGINT AS body_n_obs, coalesce(sum(span) FILTER (kind = 'body'), 0)::BIGINT AS body_span FROM kn GROUP BY 1),
br AS (SELECT source_id, count(*) FILTER (NOT ok) AS breaks FROM ct GROUP BY 1),
v AS (SELECT b.*, coalesce(breaks, 0) AS breaks, CASE WHEN body_span > 0 THEN round_even(body_n_obs / body_span, 3) ELSE 0.0 END AS body_coverage FROM bs b LEFT JOIN br USING (source_id))
SELECT *, CASE WHEN body_n_obs < 5 OR body_coverage < 0.6 THEN 'degraded' WHEN breaks > 0 THEN 'needs_review' ELSE 'calibrated' END AS verdict,
  CASE WHEN body_n_obs < 5 OR body_coverage < 0.6 THEN 'section_only' ELSE 'paginated' END AS locator_type FROM v""")
def a08(spark, sf):
    segs = _calibrated(spark, sf)
    return cal.verdict(segs, cal.continuity(segs))


@query("a14_dominant_segment", f'{EXT} SELECT source_id, shard_ord, arg_max("offset", struct_pack(a := n_obs, b := -span, c := -page_start)) AS main FROM ext GROUP BY 1, 2')
def a14(spark, sf):
    return _extended(spark, sf).groupBy("source_id", "shard_ord").agg(F.max_by("offset", F.struct("n_obs", -F.col("span"), -F.col("page_start"))).alias("main"))


def _pages(spark, sf):
    return views.page_observations(spark, sf).select("source_id", "shard_ord", "page_idx").distinct()


@query("j01_locator", f"{PAGES} SELECT * FROM lc")
def j01(spark, sf):
    return cal.locators(_pages(spark, sf), _calibrated(spark, sf))


@query("k08_page_anchors", f"""{PAGES} SELECT source_id, shard_ord, page_idx, coalesce('<!-- p=' || locator || ' -->', '<!-- p=pdf-' || (200 * (shard_ord - 1) + page_idx + 1) || ' unmapped -->') AS anchor
  FROM lc""")
def anchors(spark, sf):
    located = cal.locators(_pages(spark, sf), _calibrated(spark, sf))
    return located.select("source_id", "shard_ord", "page_idx", cal.anchor("locator", F.expr("200 * (shard_ord - 1) + page_idx + 1")).alias("anchor"))


PHYS = f"""{KIND}, wn AS (SELECT s.source_id, u.printed FROM (SELECT DISTINCT source_id FROM v1) s, LATERAL (SELECT unnest(range(1, 301)) AS printed) u),
pgs AS (SELECT k.source_id, k.shard_ord, k.kind, k.n_obs, k.page_start, k.seg_ord, u.page_idx, u.page_idx + k."offset" AS printed
  FROM kn k, LATERAL (SELECT unnest(range(k.page_start, k.page_end + 1)) AS page_idx) u),
ps AS (SELECT DISTINCT ON (source_id, printed) source_id, printed, shard_ord, page_idx FROM pgs ORDER BY source_id, printed, (kind <> 'body'), n_obs DESC, shard_ord, page_start, seg_ord)"""


@query("j02_physical_page", f"{PHYS} SELECT w.source_id, w.printed, ps.shard_ord, ps.page_idx FROM wn w LEFT JOIN ps USING (source_id, printed)")
def j02(spark, sf):
    wanted = views.page_observations(spark, sf).select("source_id").distinct().withColumn("printed", F.explode(F.sequence(F.lit(1).cast(L), F.lit(300).cast(L))))
    return cal.physical_pages(wanted, _calibrated(spark, sf))


@query("c26_locator_collision", f"""{PAGES} SELECT source_id, shard_ord, locator, count(*) AS pages, min(page_idx) AS first_page, max(page_idx) AS last_page
  FROM lc WHERE locator IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""")
def c26(spark, sf):
    return cal.collisions(cal.locators(_pages(spark, sf), _calibrated(spark, sf)))


DOM = f"""{KIND}, ds AS (SELECT source_id, shard_ord, "offset", sum(n_obs)::BIGINT AS obs, sum(span)::BIGINT AS pages, min(page_start) AS since FROM kn GROUP BY ALL),
dm AS (SELECT source_id, shard_ord, arg_max("offset", struct_pack(a := obs, b := pages, c := -since)) AS main FROM ds GROUP BY 1, 2),
ow AS (SELECT k.*, d.main, last_value(CASE WHEN k."offset" = d.main THEN page_end END IGNORE NULLS) OVER (PARTITION BY k.source_id, k.shard_ord ORDER BY page_start, seg_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf,
  first_value(CASE WHEN k."offset" = d.main THEN page_start END IGNORE NULLS) OVER (PARTITION BY k.source_id, k.shard_ord ORDER BY page_start, seg_ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS bh
  FROM kn k JOIN dm d USING (source_id, shard_ord)),
ol AS (SELECT source_id, shard_ord, page_start, page_end, printed_start AS observed, page_start + main AS expected FROM ow WHERE span <= 2 AND "offset" <> main AND page_start - bf <= 4 AND bh - page_end <= 4)"""


@query("a13_dominant_offset", f"{DOM} SELECT * FROM dm")
def a13(spark, sf):
    return cal.dominant_offsets(_calibrated(spark, sf))


RAWOL = DOM.replace(KIND, f"{SEG}, kn AS (SELECT * FROM seg)")


@query("w17_outlier_pages", f"{RAWOL} SELECT * FROM ol")
def w17(spark, sf):
    return cal.outlier_pages(cal.segments(views.page_observations(spark, sf)))


@query("c21_outlier_per_shard", f"{RAWOL} SELECT source_id, shard_ord, count(*) AS pages, min(page_start) AS first_page, 'high' AS severity FROM ol GROUP BY 1, 2")
def c21(spark, sf):
    out = cal.outlier_pages(cal.segments(views.page_observations(spark, sf)))
    return out.groupBy("source_id", "shard_ord").agg(F.count("*").alias("pages"), F.min("page_start").alias("first_page")).withColumn("severity", F.lit("high"))


@query("c22_short_segment", f"""{RAWOL} SELECT s.source_id, s.shard_ord, s.page_start, s.page_end, 'warn' AS severity FROM seg s WHERE span <= 2 AND NOT EXISTS (SELECT 1
  FROM ol WHERE ol.source_id = s.source_id AND ol.shard_ord = s.shard_ord AND ol.page_start = s.page_start AND ol.page_end = s.page_end)""")
def c22(spark, sf):
    segs = cal.segments(views.page_observations(spark, sf))
    out = cal.outlier_pages(segs).select("source_id", "shard_ord", "page_start", "page_end")
    return segs.filter("span <= 2").join(out, out.columns, "left_anti").select(*out.columns, F.lit("warn").alias("severity"))


@query("c23_segment_overlap", f"""{KIND}, lo AS (SELECT *, lag(printed_end) OVER w AS pe, lag(page_start) OVER w AS ps FROM kn WINDOW w AS (PARTITION BY source_id, kind ORDER BY shard_ord, page_start, seg_ord))
SELECT source_id, kind, shard_ord, page_start, ps AS prev_start, pe AS prev_printed_end, printed_start, CASE WHEN kind = 'front' THEN 'warn' ELSE 'high' END AS severity FROM lo WHERE printed_start <= pe""")
def c23(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("source_id", "kind").orderBy("shard_ord", "page_start", "seg_ord")
    s = _calibrated(spark, sf).withColumns({"prev_printed_end": F.lag("printed_end").over(w), "prev_start": F.lag("page_start").over(w)})
    severity = F.when(F.col("kind") == "front", "warn").otherwise("high")
    return s.filter("printed_start <= prev_printed_end").select("source_id", "kind", "shard_ord", "page_start", "prev_start", "prev_printed_end", "printed_start", severity.alias("severity"))


@query("c24_continuity_finding", f"{CONT} SELECT source_id, shard_ord, page_start, expected, next_printed, 'high' AS severity FROM ct WHERE NOT ok")
def c24(spark, sf):
    return cal.continuity(_calibrated(spark, sf)).filter("not ok").select("source_id", "shard_ord", "page_start", "expected", "next_printed", F.lit("high").alias("severity"))


@query("c25_declared_gap", f"""{KIND}, gl AS (SELECT *, lag(page_end) OVER (PARTITION BY source_id, shard_ord ORDER BY page_start, seg_ord) AS ap
  FROM kn) SELECT source_id, shard_ord, ap AS after_page, page_start AS before_page, 'info' AS severity FROM gl WHERE page_start - ap > 1""")
def c25(spark, sf):
    return cal.gaps(_calibrated(spark, sf)).select("source_id", "shard_ord", "after_page", "before_page", F.lit("info").alias("severity"))


ANCH = f"""{KIND}, an0 AS (SELECT source_id, shard_ord, page_idx, printed + 3 AS printed FROM v1 WHERE event_id % 97 = 0),
np AS (SELECT source_id, shard_ord, max(page_idx) + 1 AS n_pages FROM v1 GROUP BY 1, 2),
an AS (SELECT a.*, lead(page_idx) OVER (PARTITION BY source_id, shard_ord ORDER BY page_idx) AS nx, min(page_idx) OVER (PARTITION BY source_id, shard_ord) AS first_, n_pages
  FROM an0 a JOIN np USING (source_id, shard_ord)),
am AS (SELECT *, greatest(page_idx, coalesce(nx - 1, n_pages - 1, page_idx)) AS end_, printed - page_idx AS "offset" FROM an),
ak AS (SELECT m.source_id, m.shard_ord, m.page_idx,
  arg_min(k.kind, struct_pack(a := k.page_start, b := k.seg_ord)) FILTER (k.page_start <= m.page_idx AND k.page_end >= m.page_idx) AS k1,
  arg_min(k.kind, struct_pack(g := least(abs(k.page_start - m.page_idx), abs(k.page_end - m.page_idx)), a := k.page_start, b := k.seg_ord)) FILTER (k."offset" = m."offset") AS k2,
  arg_max(k.kind, struct_pack(a := k.page_end, b := -k.seg_ord)) FILTER (k.page_end < m.page_idx) AS k3
  FROM am m LEFT JOIN kn k USING (source_id, shard_ord) GROUP BY 1, 2, 3),
mf AS (SELECT DISTINCT source_id, shard_ord, first_ FROM am),
od AS (SELECT k.*, first_, first_ IS NOT NULL AND page_end >= first_ AS cut FROM kn k LEFT JOIN mf USING (source_id, shard_ord) WHERE first_ IS NULL OR page_start < first_),
fin AS (SELECT source_id, shard_ord, page_start, CASE WHEN cut THEN first_ - 1 ELSE page_end END AS page_end, printed_start, CASE WHEN cut THEN first_ - 1 + "offset" ELSE printed_end END AS printed_end, "offset", n_obs,
  CASE WHEN cut THEN first_ - 1 ELSE page_end END - page_start + 1 AS span, CASE WHEN cut THEN round_even(n_obs / (first_ - page_start), 3) ELSE coverage END AS coverage, confidence, kind FROM od
  UNION ALL SELECT m.source_id, m.shard_ord, m.page_idx, end_, printed, end_ + "offset", "offset", 0, end_ - m.page_idx + 1, 0.0, 'manual', coalesce(k1, k2, k3, 'body') FROM am m JOIN ak USING (source_id, shard_ord, page_idx))"""


@query("w18_apply_anchors", f"{ANCH} SELECT * FROM fin")
def w18(spark, sf):
    obs = views.page_observations(spark, sf)
    anchors = obs.filter("event_id % 97 = 0").selectExpr("source_id", "shard_ord", "page_idx", "printed + 3 as printed")
    pages = obs.groupBy("source_id", "shard_ord").agg((F.max("page_idx") + 1).alias("n_pages"))
    return cal.apply_anchors(_calibrated(spark, sf), anchors, pages)


@query("s06_shard_sizes", f"WITH {V1} SELECT source_id, shard_ord, max(page_idx) + 1 AS n_pages, count(*) AS n_items FROM v1 GROUP BY 1, 2")
def s06(spark, sf):
    return views.page_observations(spark, sf).groupBy("source_id", "shard_ord").agg((F.max("page_idx") + 1).alias("n_pages"), F.count("*").alias("n_items"))


@query("w22_page_offsets", f"""WITH {V1}, s AS (SELECT source_id, shard_ord, max(page_idx) + 1 AS n_pages
  FROM v1
  GROUP BY 1, 2)
  SELECT source_id, shard_ord, n_pages, coalesce(sum(n_pages) OVER (PARTITION BY source_id ORDER BY shard_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pages_before
  FROM s""")
def w22(spark, sf):
    from pyspark.sql import Window

    s = views.page_observations(spark, sf).groupBy("source_id", "shard_ord").agg((F.max("page_idx") + 1).alias("n_pages"))
    w = Window.partitionBy("source_id").orderBy("shard_ord").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("pages_before", F.coalesce(F.sum("n_pages").over(w), F.lit(0)))


@query("g3_page_consistency", f"""{CONT}, b3 AS (SELECT source_id, count(*) FILTER (printed_end - printed_start <> page_end - page_start) AS broken, count(*) FILTER (confidence = 'low') AS low FROM kn GROUP BY 1),
c3 AS (SELECT source_id, count(*) FILTER (NOT ok) AS breaks FROM ct GROUP BY 1)
SELECT source_id, broken, low, coalesce(breaks, 0) AS breaks, CASE WHEN broken > 0 THEN 'fail' WHEN low > 0 OR coalesce(breaks, 0) > 0 THEN 'warn' ELSE 'pass' END AS status FROM b3 LEFT JOIN c3 USING (source_id)""")
def g3(spark, sf):
    from quire.operators import verify

    segs = _calibrated(spark, sf)
    return verify.page_consistency(segs, cal.continuity(segs))
