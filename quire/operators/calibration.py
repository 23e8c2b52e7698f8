"""Printed-page calibration: from page numbers seen on pages to page segments of constant offset.

Every operator takes the pages of many sources at once and works by (source_id, shard_ord),
so nothing is ordered beyond one shard of one source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text

#: Thresholds of segments and of the verdict.
HIGH_OBS, HIGH_COVERAGE = 3, 0.75
MEDIUM_OBS, MEDIUM_COVERAGE = 2, 0.50
BODY_OBS, BODY_COVERAGE = 5, 0.60
HEADER_REACH, OUTLIER_SPAN, AUDIT_REACH = 12, 2, 4

SHARD = ("source_id", "shard_ord")


def observations(blocks: DataFrame) -> DataFrame:
    """Page numbers and numbered headers of blocks(source_id, shard_ord, page_idx, gid, type, text); the first of each kind on a page counts."""
    number = F.when(F.col("type") == "page_number", text.page_number("text")).when(F.col("type") == "header", text.header_number("text"))
    seen = blocks.filter(F.col("type").isin("page_number", "header")).withColumn("printed", number.cast("long")).filter("printed is not null")
    return first_on_page(seen.withColumnRenamed("type", "kind"), "gid")


def first_on_page(obs: DataFrame, order: str) -> DataFrame:
    """The first observation of each kind on each page."""
    return obs.groupBy(*SHARD, "page_idx", "kind").agg(F.min_by("printed", order).alias("printed"))


def header_conflicts(first: DataFrame) -> DataFrame:
    """Pages whose page number and header disagree."""
    p = first.filter("kind = 'page_number'").select(*SHARD, "page_idx", F.col("printed").alias("page_number"))
    h = first.filter("kind = 'header'").select(*SHARD, "page_idx", F.col("printed").alias("header"))
    return p.join(h, [*SHARD, "page_idx"]).filter("page_number <> header")


def ratio(n: Column | str, span: Column | str) -> Column:
    return F.bround(text.col(n) / text.col(span), 3)


def confidence(n: Column, span: Column) -> Column:
    share = n / span
    return F.when((n >= HIGH_OBS) & (share >= HIGH_COVERAGE), "high").when((n >= MEDIUM_OBS) & (share >= MEDIUM_COVERAGE), "medium").otherwise("low")


def segments(obs: DataFrame) -> DataFrame:
    """Runs of observations(source_id, shard_ord, page_idx, printed[, kind]) with one offset, strictly forward."""
    kind = F.col("kind") if "kind" in obs.columns else F.lit("page_number")
    rows = obs.select(*SHARD, "page_idx", "printed", kind.alias("kind")).withColumn("second", F.when(F.col("kind") == "page_number", 0).otherwise(1))
    w = Window.partitionBy(*SHARD).orderBy("page_idx", "second", "printed")
    page, printed = F.lag("page_idx").over(w), F.lag("printed").over(w)
    goes_on = (F.col("printed") - F.col("page_idx") == printed - page) & (F.col("printed") > printed) & (F.col("page_idx") > page)
    rows = rows.withColumn("opens", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("seg_ord", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seen = F.when(F.col("kind") == "page_number", F.col("page_idx"))
    out = rows.groupBy(*SHARD, "seg_ord").agg(
        F.min("page_idx").alias("page_start"), F.max("page_idx").alias("page_end"), F.min("printed").alias("printed_start"), F.max("printed").alias("printed_end"),
        F.count("*").alias("n_obs"), F.array_sort(F.collect_list(seen)).alias("basis_pages"),
    )
    out = out.withColumn("offset", F.col("printed_start") - F.col("page_start")).withColumn("span", F.col("page_end") - F.col("page_start") + 1)
    return out.withColumns({"coverage": ratio("n_obs", "span"), "confidence": confidence(F.col("n_obs"), F.col("span")), "derived": F.col("span") > F.col("n_obs")})


def extend_with_headers(segs: DataFrame, obs: DataFrame) -> DataFrame:
    """Segments reaching over headers of the same offset: back once, forward from header to header, 12 pages at most each."""
    heads = obs.filter("kind = 'header'").groupBy(*SHARD, (F.col("printed") - F.col("page_idx")).alias("offset")).agg(F.array_sort(F.collect_list("page_idx")).alias("pages"))
    rows = segs.join(heads, [*SHARD, "offset"], "left").withColumn("pages", F.coalesce("pages", F.array().cast("array<bigint>")))
    start = F.expr(f"coalesce(array_min(filter(pages, p -> p >= page_start - {HEADER_REACH} and p < page_start)), page_start)")
    end = F.expr(f"aggregate(pages, page_end, (e, p) -> if(p > e and p <= e + {HEADER_REACH}, p, e))")
    rows = rows.withColumns({"page_start": start, "page_end": end}).drop("pages")
    rows = rows.withColumns({"printed_start": F.col("page_start") + F.col("offset"), "printed_end": F.col("page_end") + F.col("offset"), "span": F.col("page_end") - F.col("page_start") + 1})
    return rows.withColumn("coverage", ratio("n_obs", "span"))


def absorb_outliers(segs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept segments, absorbed pages): short segments between two of the shard's main offset join the one before."""
    whole = Window.partitionBy(*SHARD)
    w = whole.orderBy("page_start", "seg_ord")
    best = F.max_by("offset", F.struct("n_obs", -F.col("span"), -F.col("page_start"), -F.col("seg_ord"))).over(whole)
    rows = segs.withColumn("main", best).withColumn("of", F.count("*").over(whole))
    is_main = F.when(F.col("offset") == F.col("main"), F.col("seg_ord"))
    rows = rows.withColumn("prev_main", F.last(is_main, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("next_main", F.first(is_main, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    out = (F.col("of") >= 3) & (F.col("span") <= OUTLIER_SPAN) & (F.col("confidence") != "manual") & (F.col("offset") != F.col("main")) & F.col("prev_main").isNotNull() & F.col("next_main").isNotNull()
    rows = rows.withColumn("absorbed", out)
    reach = rows.filter("absorbed").groupBy(*SHARD, F.col("prev_main").alias("seg_ord")).agg(F.max("page_end").alias("reach"))
    kept = rows.filter("not absorbed").join(reach, [*SHARD, "seg_ord"], "left")
    longer = F.col("reach").isNotNull()
    kept = kept.withColumn("page_end", F.greatest("page_end", F.coalesce("reach", "page_end"))).withColumn("printed_end", F.when(longer, F.col("page_end") + F.col("offset")).otherwise(F.col("printed_end")))
    kept = kept.withColumn("span", F.col("page_end") - F.col("page_start") + 1).withColumn("coverage", F.when(longer, ratio("n_obs", "span")).otherwise(F.col("coverage")))
    gone = rows.filter("absorbed").select(*SHARD, F.col("page_start").alias("page_idx"), F.col("printed_start").alias("observed"), (F.col("page_start") + F.col("main")).alias("expected"))
    return kept.drop("main", "of", "prev_main", "next_main", "absorbed", "reach"), gone


def with_kinds(segs: DataFrame) -> DataFrame:
    """Segments with kind: the longest of a shard is body, those that end before it are front matter."""
    body = F.max_by("page_start", F.struct("span", "n_obs", -F.col("page_start"), -F.col("seg_ord"))).over(Window.partitionBy(*SHARD))
    return segs.withColumn("kind", F.when(F.col("page_end") < body, "front").otherwise("body"))


def continuity(segs: DataFrame) -> DataFrame:
    """Each body segment against the one before it in the source."""
    w = Window.partitionBy("source_id").orderBy("shard_ord", "page_start", "seg_ord")
    rows = segs.filter("kind = 'body'").withColumns({"prev_shard": F.lag("shard_ord").over(w), "prev_end": F.lag("page_end").over(w), "prev_printed": F.lag("printed_end").over(w)})
    rows = rows.filter("prev_printed is not null").withColumn("expected", F.col("prev_printed") + 1)
    note = F.when(F.col("printed_start") == F.col("expected"), "continues").when(F.col("printed_start") > F.col("expected"), "gap").otherwise("backwards")
    return rows.select("source_id", "prev_shard", "prev_end", "shard_ord", "page_start", "prev_printed", F.col("printed_start").alias("next_printed"), "expected", (F.col("printed_start") >= F.col("expected")).alias("ok"), note.alias("note"))


def gaps(segs: DataFrame) -> DataFrame:
    """Pages between neighbouring segments of a shard, and the numbers they would have had."""
    w = Window.partitionBy(*SHARD).orderBy("page_start", "seg_ord")
    rows = segs.withColumns({"after": F.lag("page_end").over(w), "printed": F.lag("printed_end").over(w)}).filter("page_start - after > 1")
    n = F.col("page_start") - F.col("after") - 1
    return rows.select(*SHARD, F.col("after").alias("after_page"), F.col("page_start").alias("before_page"), n.alias("n_unmapped"), F.sequence(F.col("printed") + 1, F.col("printed") + n).alias("missing_printed"))


def verdict(segs: DataFrame, checks: DataFrame) -> DataFrame:
    """One row for each source: observations and span of its body, locator type and verdict."""
    body = segs.groupBy("source_id").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == "body", F.col(c))), F.lit(0)).cast("long").alias(f"body_{c}") for c in ("n_obs", "span")])
    failed = checks.groupBy("source_id").agg(F.count_if(~F.col("ok")).alias("breaks"))
    rows = body.join(failed, "source_id", "left").withColumn("breaks", F.coalesce("breaks", F.lit(0)).cast("long"))
    rows = rows.withColumn("body_coverage", F.when(F.col("body_span") > 0, ratio("body_n_obs", "body_span")).otherwise(0.0))
    weak = (F.col("body_n_obs") < BODY_OBS) | (F.col("body_coverage") < BODY_COVERAGE)
    said = F.when(weak, "degraded").when(F.col("breaks") > 0, "needs_review").otherwise("calibrated")
    return rows.withColumn("verdict", said).withColumn("locator_type", F.when(weak, "section_only").otherwise("paginated"))


def on_pages(segs: DataFrame) -> DataFrame:
    """A row for each page that a segment covers."""
    return segs.withColumn("page_idx", F.explode(F.sequence("page_start", "page_end"))).withColumn("printed", F.col("page_idx") + F.col("offset"))


def locators(pages: DataFrame, segs: DataFrame) -> DataFrame:
    """pages(source_id, shard_ord, page_idx) with the locator by which a reader finds the page; null outside all segments.

    Segments are spread over their pages, so the interval join is an equi-join; the first
    segment counts. A front-matter number that several front segments of a source have is
    qualified by shard and segment.
    """
    covered = on_pages(segs)
    first = covered.groupBy(*SHARD, "page_idx").agg(F.min_by(F.struct("kind", "printed", "page_start"), F.struct("page_start", "seg_ord")).alias("s"))
    fronts = covered.filter("kind = 'front'").groupBy("source_id", "printed").agg(F.count("*").alias("fronts"))
    rows = pages.join(first, [*SHARD, "page_idx"], "left").withColumn("printed", F.col("s.printed"))
    rows = rows.join(fronts, ["source_id", "printed"], "left")
    plain = F.col("printed").cast("string")
    front = F.concat(F.lit("front-"), plain)
    qualified = F.concat(front, F.lit("-P"), F.col("shard_ord"), F.lit("-s"), F.col("s.page_start"))
    locator = F.when(F.col("s.kind") == "front", F.when(F.col("fronts") > 1, qualified).otherwise(front)).otherwise(plain)
    return rows.select(*pages.columns, locator.alias("locator"))


def anchor(locator: Column | str, global_page: Column | str) -> Column:
    """The comment line that marks a page in rendered text."""
    known = F.concat(F.lit("<!-- p="), text.col(locator), F.lit(" -->"))
    return F.coalesce(known, F.concat(F.lit("<!-- p=pdf-"), text.col(global_page).cast("string"), F.lit(" unmapped -->")))


def physical_pages(printed: DataFrame, segs: DataFrame) -> DataFrame:
    """printed(source_id, printed) with the page that carries the number: body first, then the best observed segment."""
    covered = on_pages(segs).select("source_id", "printed", "shard_ord", "page_idx", "kind", "n_obs", "page_start", "seg_ord")
    order = F.struct((F.col("kind") != "body").alias("a"), -F.col("n_obs"), "shard_ord", "page_start", "seg_ord")
    best = covered.groupBy("source_id", "printed").agg(F.min_by(F.struct("shard_ord", "page_idx"), order).alias("p"))
    return printed.join(best, ["source_id", "printed"], "left").select(*printed.columns, "p.shard_ord", "p.page_idx")


def collisions(located: DataFrame) -> DataFrame:
    """Locators that several pages of a shard share."""
    return located.filter("locator is not null").groupBy(*SHARD, "locator").agg(F.count("*").alias("pages"), F.min("page_idx").alias("first_page"), F.max("page_idx").alias("last_page")).filter("pages >= 2")


def apply_anchors(segs: DataFrame, anchors: DataFrame, shard_pages: DataFrame) -> DataFrame:
    """Segments overridden by anchors(source_id, shard_ord, page_idx, printed); shard_pages has n_pages.

    An anchor holds to the next one or the end of its shard; what lies before the first stays,
    cut where it crosses it. Its kind is that of the segment it falls into, of the nearest with
    its offset, of the last before it, or body.
    """
    w = Window.partitionBy(*SHARD).orderBy("page_idx")
    a = anchors.filter("page_idx is not null and printed is not null").withColumn("page_idx", F.greatest("page_idx", F.lit(0)))
    a = a.withColumn("next", F.lead("page_idx").over(w)).withColumn("first", F.min("page_idx").over(Window.partitionBy(*SHARD))).join(shard_pages.select(*SHARD, "n_pages"), list(SHARD), "left")
    a = a.withColumn("end", F.greatest("page_idx", F.coalesce(F.col("next") - 1, F.col("n_pages") - 1, "page_idx"))).withColumn("offset", F.col("printed") - F.col("page_idx"))
    s = segs.select(*SHARD, "page_start", "page_end", F.col("offset").alias("o"), "kind", "seg_ord")
    near = a.join(s, list(SHARD), "left")
    gap = F.least(F.abs(F.col("page_start") - F.col("page_idx")), F.abs(F.col("page_end") - F.col("page_idx")))
    inside = (F.col("page_start") <= F.col("page_idx")) & (F.col("page_end") >= F.col("page_idx"))
    order = F.struct("page_start", "seg_ord")
    pick = near.groupBy(*SHARD, "page_idx").agg(
        F.min_by("kind", F.when(inside, order)).alias("k1"), F.min_by("kind", F.when(F.col("o") == F.col("offset"), F.struct(gap, order))).alias("k2"),
        F.max_by("kind", F.when(F.col("page_end") < F.col("page_idx"), F.struct("page_end", -F.col("seg_ord")))).alias("k3"),
    )
    made = a.join(pick, [*SHARD, "page_idx"]).select(
        *SHARD, F.col("page_idx").alias("page_start"), F.col("end").alias("page_end"), F.col("printed").alias("printed_start"), (F.col("end") + F.col("offset")).alias("printed_end"), "offset",
        F.lit(0).cast("long").alias("n_obs"), (F.col("end") - F.col("page_idx") + 1).alias("span"), F.lit(0.0).alias("coverage"), F.lit("manual").alias("confidence"), F.coalesce("k1", "k2", "k3", F.lit("body")).alias("kind"),
    )
    firsts = a.select(*SHARD, "first").distinct()
    old = segs.join(firsts, list(SHARD), "left").filter("first is null or page_start < first")
    old = old.withColumn("cut", F.col("first").isNotNull() & (F.col("page_end") >= F.col("first")))
    cut = F.col("cut")
    old = old.withColumn("page_end", F.when(cut, F.col("first") - 1).otherwise(F.col("page_end"))).withColumn("printed_end", F.when(cut, F.col("page_end") + F.col("offset")).otherwise(F.col("printed_end")))
    old = old.withColumn("span", F.col("page_end") - F.col("page_start") + 1).withColumn("coverage", F.when(cut, ratio("n_obs", "span")).otherwise(F.col("coverage")))
    return old.select(*made.columns).unionByName(made)


def dominant_offsets(segs: DataFrame) -> DataFrame:
    """Per shard the offset with most observations, then pages, over all its segments (manual ones aside)."""
    sums = segs.filter("confidence <> 'manual'").groupBy(*SHARD, "offset").agg(F.sum("n_obs").alias("obs"), F.sum("span").alias("pages"), F.min("page_start").alias("since"))
    return sums.groupBy(*SHARD).agg(F.max_by("offset", F.struct("obs", "pages", -F.col("since"))).alias("main"))


def outlier_pages(segs: DataFrame) -> DataFrame:
    """Short segments off the dominant offset with it on both sides within 4 pages: misread numbers."""
    rows = segs.join(dominant_offsets(segs), list(SHARD))
    w = Window.partitionBy(*SHARD).orderBy("page_start", "seg_ord")
    is_main = F.col("offset") == F.col("main")
    rows = rows.withColumn("before", F.last(F.when(is_main, F.col("page_end")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("behind", F.first(F.when(is_main, F.col("page_start")), True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    near = (F.col("page_start") - F.col("before") <= AUDIT_REACH) & (F.col("behind") - F.col("page_end") <= AUDIT_REACH)
    found = rows.filter((F.col("span") <= OUTLIER_SPAN) & (F.col("confidence") != "manual") & ~is_main & near)
    return found.select(*SHARD, "page_start", "page_end", F.col("printed_start").alias("observed"), (F.col("page_start") + F.col("main")).alias("expected"))


def calibrated(obs: DataFrame) -> DataFrame:
    """Segments with kinds, from mixed observations: the whole chain."""
    kept, _ = absorb_outliers(extend_with_headers(segments(obs), obs))
    return with_kinds(kept)


def all_rows(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
