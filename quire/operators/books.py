"""The whole chain for books: blocks to calibration, outline, overlay, ownership and audit.

Each stage is written to the shared folder before the next one begins, so plans stay small,
lost executors cost their running tasks only, and blocks are dealt by source once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import numbering, text
from quire.operators import audit, calibration, outline
from quire.tables import stored

#: The title of what comes before the first heading, and prefixes of keys that aren't block numbers.
FRONT_TITLE = "前置（封面·书名页·版权页）"
REPAIRED, ADDED = "toc", "add"
LEAST_LEVEL, MOST_LEVEL = 1, 9


class Overlay(NamedTuple):
    """Corrections by hand: levels(source_id, key, level), deleted(source_id, key), added(source_id, gid, title, level, offset), anchors(source_id, shard_ord, page_idx, printed); any may be None."""

    levels: DataFrame | None = None
    deleted: DataFrame | None = None
    added: DataFrame | None = None
    anchors: DataFrame | None = None


class Outline(NamedTuple):
    """An automatic tree with what was dropped, listed, repaired and added on the way."""

    dropped: DataFrame
    entries: DataFrame
    repairs: DataFrame
    additions: DataFrame
    tree: DataFrame


class Book(NamedTuple):
    segments: DataFrame
    verdicts: DataFrame
    dropped: DataFrame
    entries: DataFrame
    repairs: DataFrame
    additions: DataFrame
    tree: DataFrame
    owned: DataFrame
    findings: DataFrame


def contents_lines(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """(source_id, ord, line): the lines of the printed contents lists, in order."""
    rows = blocks.filter("type = 'text'").join(regions.withColumnRenamed("shard_ord", "toc_shard"), "source_id").filter("shard_ord = toc_shard and page_idx between heading_page and last_page")
    rows = rows.select("source_id", "gid", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return rows.select("source_id", (F.shiftleft("gid", 32) + F.col("k")).alias("ord"), "line")


def synthetic_key(prefix: str, shard_ord: Column | str, gid: Column | str, title: Column | str) -> Column:
    """The key of a node that borrows a block: what it is, where, and its title."""
    return F.concat(F.lit(f"{prefix}:P"), text.col(shard_ord), F.lit(":"), text.col(gid), F.lit(":"), text.title_key(title))


def repairs(blocks: DataFrame, entries: DataFrame, titles: DataFrame, segs: DataFrame) -> DataFrame:
    """(source_id, ord, title, printed, status, shard_ord, page_idx, gid, key): contents entries without a heading.

    They are put before the first block of the page that has their number, or of one of the
    three pages after it.
    """
    asked = entries.filter("kind = 'chapter' and printed is not null and printed <> 0")
    pages = calibration.physical_pages(asked.select("source_id", "printed").distinct(), segs)
    found = outline.first_blocks(pages.filter("page_idx is not null").select("source_id", "shard_ord", "page_idx").distinct(), blocks)
    placed = pages.join(found, ["source_id", "shard_ord", "page_idx"], "left")
    at = blocks.select("source_id", "gid", F.col("page_idx").alias("at_page"))
    placed = placed.join(at, ["source_id", "gid"], "left").select("source_id", "printed", F.col("page_idx").isNotNull().alias("page_known"), "shard_ord", F.coalesce("at_page", "page_idx").alias("page_idx"), "gid")
    rows = asked.join(placed, ["source_id", "printed"], "left").withColumn("page_known", F.coalesce("page_known", F.lit(False)))
    out = rows.join(outline.repaired_entries(rows, titles), ["source_id", "ord"])
    key = F.when(F.col("status") == "added", synthetic_key(REPAIRED, "shard_ord", "gid", "title"))
    return out.select("source_id", "ord", "title", "printed", "status", "shard_ord", "page_idx", "gid", key.alias("key"))


def additions(blocks: DataFrame, added: DataFrame) -> DataFrame:
    """(source_id, gid, title, level, offset, status, shard_ord, page_idx, key): headings added by hand; those without a block or a title are passed over."""
    at = blocks.select("source_id", "gid", "shard_ord", "page_idx", F.lit(True).alias("there"))
    rows = added.join(at, ["source_id", "gid"], "left").withColumn("title", text.strip(F.coalesce("title", F.lit(""))))
    status = F.when(F.col("there").isNull(), "no block").when(F.col("title") == "", "no title").otherwise("added")
    offset = F.greatest(F.lit(0), F.coalesce("offset", F.lit(0))) if "offset" in added.columns else F.lit(0)
    level = F.greatest(F.lit(LEAST_LEVEL), F.least(F.lit(MOST_LEVEL), F.coalesce("level", F.lit(1))))
    return rows.select("source_id", "gid", "title", level.cast("long").alias("level"), offset.cast("long").alias("offset"), status.alias("status"), "shard_ord", "page_idx", F.concat(F.lit(f"{ADDED}:"), F.col("gid")).alias("key"))


def unique_keys(rows: DataFrame) -> DataFrame:
    """Candidates(source_id, seq, key) whose repeated keys have their place (from 0) as a suffix."""
    nth = F.row_number().over(Window.partitionBy("source_id", "key").orderBy("seq"))
    return rows.withColumn("key", F.when(nth > 1, F.concat(F.col("key"), F.lit("#"), F.col("seq") - 1)).otherwise(F.col("key")))


def found_headings(blocks: DataFrame, segs: DataFrame, trusted: bool = False) -> Outline:
    """An outline without additions and without its tree: candidates that stay and that go, the contents list, repairs."""
    regions, running = outline.toc_regions(blocks), outline.running_texts(blocks)
    found = stored(outline.heading_candidates(blocks, regions, running, trusted), "candidates")
    entries = stored(outline.printed_toc(contents_lines(blocks, regions)), "contents")
    kept, none = found.filter("marker is not null"), found.limit(0)
    mended = none.select("source_id", F.lit(0).cast("long").alias("ord"), F.lit("").alias("title"), F.lit(0).cast("long").alias("printed"), F.lit("").alias("status"), "shard_ord", "page_idx", "gid", F.lit("").alias("key"))
    if not trusted:  # a publisher's levels need no repair
        mended = stored(repairs(blocks, entries, kept.select("source_id", F.col("text").alias("title")), segs), "repairs")
    extra = none.select("source_id", "gid", F.lit("").alias("title"), F.lit(1).cast("long").alias("level"), F.lit(0).cast("long").alias("offset"), F.lit("").alias("status"), "shard_ord", "page_idx", F.lit("").alias("key"))
    return Outline(found.filter("drop_reason is not null"), entries, mended, extra, kept)


def arranged(blocks: DataFrame, found: Outline, trusted: bool = False) -> DataFrame:
    """The automatic tree of found_headings() and what was repaired and added, with a node for the front matter."""
    kept = found.tree
    level = F.coalesce("text_level", F.lit(0)).cast("int") if trusted else F.lit(0)
    own = kept.select("source_id", "gid", F.lit(0).alias("borrowed"), F.lit(0).cast("long").alias("tie"), F.col("gid").cast("string").alias("key"), "text", "marker", "shard_ord", "page_idx", F.lit(0).cast("long").alias("offset"), level.alias("trusted_level"))

    def put(rows: DataFrame, borrowed: int, tie: str, offset: Column) -> DataFrame:
        return rows.filter("status = 'added'").select(
            "source_id", "gid", F.lit(borrowed).alias("borrowed"), F.col(tie).alias("tie"), "key", F.col("title").alias("text"), F.lit("chapter").alias("marker"), "shard_ord", "page_idx", offset.alias("offset"), F.lit(0).alias("trusted_level")
        )

    every = calibration.all_rows(own, put(found.repairs, 1, "ord", F.lit(0).cast("long")), put(found.additions, 2, "gid", F.col("offset")))
    seq = F.row_number().over(Window.partitionBy("source_id").orderBy("gid", F.col("borrowed") > 0, "borrowed", "tie", "key")).cast("long")
    every = unique_keys(every.withColumn("seq", seq)).withColumn("title", text.clean_title("text"))
    listed = found.entries.select("source_id", text.title_key("title").alias("k"), F.lit(True).alias("listed")).distinct()
    every = every.withColumn("k", text.title_key("title")).join(listed, ["source_id", "k"], "left")
    every = every.withColumn("in_toc", F.coalesce("listed", F.lit(False))).withColumn("unnumbered", ~numbering.has_numbering(text.strip("text"))).drop("k", "listed", "tie", "text")
    every = stored(every.unionByName(front_nodes(blocks, every)), "headings")
    placed = outline.placed_tree(every.select("source_id", "seq", "marker", "unnumbered", "in_toc", "trusted_level"))
    tree = every.select("source_id", "seq", "key", "marker", "title", "gid", "borrowed", "offset", "shard_ord", "page_idx").join(placed, ["source_id", "seq"])
    return stored(tree.withColumn("level", F.col("depth")), "tree")


def outlined(blocks: DataFrame, segs: DataFrame, trusted: bool = False) -> Outline:
    """The automatic outline of blocks, with headings repaired from the contents list."""
    found = found_headings(blocks, segs, trusted)
    return found._replace(tree=arranged(blocks, found, trusted))


def front_nodes(blocks: DataFrame, headings: DataFrame) -> DataFrame:
    """A node for what comes before a source's first heading, if anything does; all of it where there is no heading."""
    first = headings.groupBy("source_id").agg(F.min("gid").alias("first"))
    begin = blocks.groupBy("source_id").agg(F.min_by(F.struct("gid", "shard_ord"), "gid").alias("b")).join(first, "source_id", "left").filter("first is null or first > b.gid")
    values = {
        "seq": F.lit(0).cast("long"), "key": F.col("b.gid").cast("string"), "marker": F.lit("front"), "title": F.lit(FRONT_TITLE), "gid": F.col("b.gid"), "borrowed": F.lit(0), "offset": F.lit(0).cast("long"),
        "shard_ord": F.col("b.shard_ord"), "page_idx": F.lit(0).cast("long"), "trusted_level": F.lit(0), "in_toc": F.lit(False), "unnumbered": F.lit(True),
    }
    return begin.select("source_id", *[values[c].alias(c) for c in headings.columns if c != "source_id"])


def reflowed(automatic: DataFrame, given: DataFrame, deleted: DataFrame | None, base: DataFrame) -> DataFrame:
    """The tree under an overlay: deleted nodes go (front matter can't), levels are those given, else those of the tree without additions, else their own; parents follow from levels."""
    rows = automatic.drop("ancestors", "parent", "depth", "ordinal", "nid", "rank")
    if deleted is not None:
        gone = deleted.select("source_id", "key", F.lit(True).alias("gone")).distinct()
        rows = rows.join(gone, ["source_id", "key"], "left").filter("gone is null or marker = 'front'").drop("gone")
    rows = rows.join(given.select("source_id", "key", F.col("level").alias("given")), ["source_id", "key"], "left")
    rows = rows.join(base.select("source_id", "key", F.col("level").alias("before")), ["source_id", "key"], "left")
    rows = rows.withColumn("level", F.coalesce("given", F.greatest(F.lit(1), F.coalesce("before", "level"))).cast("long")).drop("given", "before")
    return outline.with_parents(rows)


def corrected(blocks: DataFrame, segs: DataFrame, trusted: bool, overlay: Overlay) -> Outline:
    """The outline under an overlay; sources without corrections keep the automatic one."""
    found = found_headings(blocks, segs, trusted)
    plain = found._replace(tree=arranged(blocks, found, trusted))
    if overlay.levels is None and overlay.deleted is None and overlay.added is None:
        return plain
    made = plain
    if overlay.added is not None:
        found = found._replace(additions=stored(additions(blocks, overlay.added), "additions"))
        made = found._replace(tree=arranged(blocks, found, trusted))
    given = overlay.levels.select("source_id", "key", F.col("level").cast("long").alias("level")) if overlay.levels is not None else made.tree.limit(0).select("source_id", "key", "level")
    more = made.additions.filter("status = 'added'").select("source_id", "key", "level").join(given, ["source_id", "key"], "left_anti")
    return made._replace(tree=stored(reflowed(made.tree, given.unionByName(more), overlay.deleted, plain.tree), "reflowed"))


def with_content(tree: DataFrame, owned: DataFrame) -> DataFrame:
    """Nodes with the content blocks and characters they own (own_*) and those of everything below them (n_*)."""
    own = outline.own_content(owned).withColumnRenamed("blocks", "own_blocks").withColumnRenamed("chars", "own_chars")
    rows = tree.join(own, ["source_id", "key"], "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("own_blocks", "own_chars")})
    total = outline.rolled_up(rows, sums=("own_blocks", "own_chars")).select("source_id", "seq", F.col("total_own_blocks").alias("n_blocks"), F.col("total_own_chars").alias("n_chars"))
    return rows.join(total, ["source_id", "seq"])


def audited(tree: DataFrame, made: Outline, segs: DataFrame, sources: DataFrame) -> DataFrame:
    """All findings (source_id, check, severity, seq, detail) about a tree; seq is null where no node is meant.

    Pages whose number was misread say nothing about the nodes on them.
    """
    located = calibration.locators(tree.select("source_id", "shard_ord", "page_idx").distinct(), segs)
    paged = tree.join(located, ["source_id", "shard_ord", "page_idx"], "left").withColumn("p", numbering.locator_parts("locator")).withColumns({"zone": F.col("p.zone"), "page": F.col("p.n").cast("long")}).drop("p")
    paged = stored(paged, "paged-tree")
    misread = calibration.outlier_pages(segs).select("source_id", "shard_ord", F.explode(F.sequence("page_start", "page_end")).alias("page_idx"))
    real = paged.filter("marker <> 'front'")
    entries = made.entries.select("source_id", "ord", "title", "printed", text.audit_key("title").alias("key"))
    matched = stored(outline.matched_entries(real.select("source_id", "seq", text.audit_key("title").alias("key")), entries), "matched-entries")
    bad = outline.misread_entries(entries).withColumn("suspect", F.lit(True))
    compared = matched.join(entries, ["source_id", "ord"]).join(real.select("source_id", "seq", "depth", "zone", "page"), ["source_id", "seq"]).join(bad, ["source_id", "ord"], "left")
    compared = compared.filter("zone = 0 and page is not null and printed is not null").withColumn("suspect", F.coalesce("suspect", F.lit(False)))
    mismatch, shift = audit.contents_deltas(compared)
    dropped = audit.dropped_findings(made.dropped, made.entries, made.repairs.filter("status = 'added'"))
    of = lambda rows, check, severity, detail: rows.select("source_id", F.col(check) if check == "check" else F.lit(check).alias("check"), F.col(severity) if severity == "severity" else F.lit(severity).alias("severity"), F.lit(None).cast("long").alias("seq"), detail.cast("string").alias("detail"))
    return calibration.all_rows(
        audit.level_jumps(real), audit.duplicate_titles(real), audit.numbering_breaks(real), audit.page_findings(audit.without_outliers(real, misread)), mismatch,
        of(shift, "toc_page_offset_shift", "info", F.col("delta")), of(audit.unmatched_entries(entries, matched), "check", "severity", F.col("ord")), of(dropped, "check", "severity", F.col("gid")),
        of(audit.contents_unavailable(sources, made.entries), "check", "severity", F.lit(None)), of(audit.calibration_missing(sources, segs), "check", "severity", F.lit(None)),
        of(calibration.outlier_pages(segs), "page_obs_outlier", "warn", F.concat_ws(" ", "page_start", "observed", "expected")),
    )


def recompute(blocks: DataFrame, trusted: bool = False, overlay: Overlay | None = None) -> Book:
    """Calibration, outline, ownership and findings of blocks(source_id, gid, shard_ord, page_idx, type, text, text_level) under an overlay."""
    overlay = overlay or Overlay()
    blocks = stored(blocks.select("source_id", "gid", "shard_ord", "page_idx", "type", "text", "text_level").repartition("source_id"), "blocks")
    segs = calibration.calibrated(calibration.observations(blocks))
    if overlay.anchors is not None:
        pages = blocks.groupBy("source_id", "shard_ord").agg((F.max("page_idx") + 1).alias("n_pages"))
        segs = calibration.apply_anchors(segs, overlay.anchors, pages).withColumn("seg_ord", F.col("page_start"))
    segs = stored(segs, "segments")
    verdicts = calibration.verdict(segs, calibration.continuity(segs))
    made = corrected(blocks, segs, trusted, overlay)
    owned = stored(outline.owners(blocks, made.tree.select("source_id", "gid", "offset", "key", "seq")), "owned")
    tree = stored(with_content(made.tree, owned), "tree-content")
    findings = audited(tree, made, segs, blocks.select("source_id").distinct())
    return Book(segs, verdicts, made.dropped, made.entries, made.repairs, made.additions, tree, owned, findings)
