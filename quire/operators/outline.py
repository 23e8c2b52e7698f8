"""Outlines: headings, contents lists, trees, ownership and roll-ups.

Trees are adjacency tables. Nodes stream past in document order, and the only thing that is
kept is the chain of open ancestors, so a tree of any depth and any number of nodes takes
one pass and no node is ever joined with the nodes before it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quire.functions import numbering, text
from quire.functions.text import SPACE, W, strip
from quire.operators.folds import fold_sources
from quire.session import ship

#: Lines that look like a contents list, its limits, and leaders before a page number.
TOC_LINE = rf"[.．·…]{{3,}}{W}*[0-9]{{1,4}}{W}*\z"
TOC_NUMBERED = rf"^.{{2,60}}{W}+[0-9]{{1,4}}{W}*\z"
TOC_PAGE_NUMBER = rf"([ 　][.．·…\-—–]*|[.．·…\-—–]{{2,}})([0-9]{{1,4}}){W}*\z"
TOC_LEADERS = r"[.．·…]{2,}"
TOC_LEAST_LINES, TOC_MOST_PAGES = 3, 12
RUNNING_PAGES, RUNNING_SHARE = 5, 0.08
FIGURE_FRAGMENT = 30
PAGE = ("source_id", "shard_ord", "page_idx")


# --- trees ---------------------------------------------------------------------------


def with_parents(nodes: DataFrame, order: str = "seq", rank: str = "level", title: str | None = None) -> DataFrame:
    """nodes with ``ancestors`` (orders of the enclosing nodes, outermost first), ``parent``, the last of them, ``depth``, ``ordinal`` among their siblings and ``nid``, the path of ordinals such as 2.1.3.

    A node's parent is the nearest one before it with a smaller rank, whatever ranks there
    are; a node without rank stands at the top and encloses nothing. Where a column of titles
    is named, ``above`` holds those of the enclosing nodes, which pass by anyway.
    """
    names = nodes.columns
    source_at, order_at, rank_at = (names.index(c) for c in ("source_id", order, rank))
    title_at = names.index(title) if title else None
    key = nodes.schema[order].dataType
    added = [StructField("ancestors", ArrayType(key)), StructField("parent", key), StructField("depth", LongType()), StructField("ordinal", LongType()), StructField("nid", StringType()), *([StructField("above", ArrayType(StringType()))] if title else [])]
    schema = StructType([*nodes.schema.fields, *added])
    kinds = to_arrow_schema(StructType(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, open_ = None, []  # (rank, order, nid, children so far, title), the first for the top
        for b in batches:
            made: list[tuple] = []
            titles = b.column(title_at).to_pylist() if title else itertools.repeat(None, b.num_rows)
            for own, at, r, t in zip(*(b.column(k).to_pylist() for k in (source_at, order_at, rank_at)), titles, strict=True):
                if own != source or not open_:
                    source, open_ = own, [[None, None, "", 0, None]]
                while r is not None and len(open_) > 1 and open_[-1][0] >= r:
                    open_.pop()
                above = open_ if r is not None else open_[:1]
                above[-1][3] += 1
                ordinal = above[-1][3]
                nid = f"{above[-1][2]}.{ordinal}" if len(above) > 1 else str(ordinal)
                place = ([x[1] for x in above[1:]], above[-1][1], len(above), ordinal, nid)
                made.append((*place, [x[4] for x in above[1:]]) if title else place)
                if r is not None:
                    open_.append([r, at, nid, 0, t])
            columns = zip(*made, strict=True) if made else [[]] * len(added)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True))], [*names, *kinds.names])

    ship(nodes.sparkSession)
    return nodes.repartition("source_id").sortWithinPartitions("source_id", order).mapInArrow(run, schema)


def breadcrumbs(tree: DataFrame, order: str = "seq") -> DataFrame:
    """Nodes with ``crumbs``, the titles of their ancestors joined from the outermost.

    Trees that with_parents() made with titles hold them already; others are joined with themselves.
    """
    if "above" in tree.columns:
        return tree.withColumn("crumbs", F.array_join("above", " › ")).drop("above")
    up = tree.select("source_id", order, F.posexplode("ancestors").alias("k", "_a"))
    titles = tree.select("source_id", F.col(order).alias("_a"), "title")
    chain = up.join(titles, ["source_id", "_a"]).groupBy("source_id", order).agg(F.array_sort(F.collect_list(F.struct("k", "title"))).alias("c"))
    joined = F.array_join(F.transform("c", lambda x: x["title"]), " › ")
    return tree.join(chain, ["source_id", order], "left").withColumn("crumbs", F.coalesce(joined, F.lit(""))).drop("c")


def rolled_up(tree: DataFrame, order: str = "seq", sums: tuple[str, ...] = ("chars", "blocks")) -> DataFrame:
    """Per node the sums over itself and everything below it, and how many nodes that are."""
    spread = tree.select("source_id", F.explode(F.concat("ancestors", F.array(order))).alias(order), *sums)
    return spread.groupBy("source_id", order).agg(*[F.sum(c).alias(f"total_{c}") for c in sums], F.count("*").alias("nodes"))


def level_stats(nodes: DataFrame, chars: str = "chars", blocks: str = "blocks") -> DataFrame:
    """Per source and level: nodes, characters in all, least, most and on average, nodes without blocks."""
    c = F.col(chars)
    return nodes.groupBy("source_id", "level").agg(
        F.count("*").alias("nodes"), F.count("*").alias("files_if_split"), F.sum(c).alias("chars"), F.min(c).alias("min_chars"), F.max(c).alias("max_chars"),
        F.count_if(F.col(blocks) == 0).alias("empty"), F.floor(F.sum(c) / F.count("*")).cast("long").alias("avg_chars"),
    )


def frontier(tree: DataFrame, depth: int, order: str = "seq") -> DataFrame:
    """The nodes whose text is one file each when a tree is cut at a depth.

    Those at the depth and leaves above it; an inner node above it that has text of its own
    before its first child stays as an introduction.
    """
    has_child = F.lead("parent").over(Window.partitionBy("source_id").orderBy(order)) == F.col(order)
    rows = tree.withColumn("leaf", ~F.coalesce(has_child, F.lit(False)))
    above = F.col("depth") < depth
    kind = F.when(F.col("depth") > depth, None).when(~above | F.col("leaf"), "piece").otherwise("introduction")
    return rows.withColumn("kind", kind).filter("kind is not null").drop("leaf")


# --- ownership -----------------------------------------------------------------------


def owners(blocks: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """blocks(source_id, gid) with ``key`` of the last breakpoint(source_id, gid, offset, key[, seq]) at or before them; null before the first.

    A block that a breakpoint cuts belongs to it as a whole; of several at one place the last
    in document order counts.
    """
    place = F.col("seq") if "seq" in breakpoints.columns else F.lit(0)
    marks = breakpoints.select("source_id", "gid", F.lit(0).alias("_b"), F.col("offset"), place.cast("long").alias("_s"), "key")
    rows = blocks.withColumn("_b", F.lit(1)).withColumn("offset", F.lit(None).cast("long")).withColumn("_s", F.lit(None).cast("long")).withColumn("key", F.lit(None).cast(marks.schema["key"].dataType))
    both = rows.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("source_id").orderBy("gid", "_b", "offset", "_s", "key").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("key", F.last("key", True).over(w)).filter("_b = 1").select(*blocks.columns, "key")


def own_content(owned: DataFrame) -> DataFrame:
    """Per key the content blocks and characters it owns itself."""
    real = text.is_content("type") & ~text.is_noise_text("text") & (strip(F.coalesce("text", F.lit(""))) != "")
    return owned.filter(real).groupBy("source_id", "key").agg(F.count("*").alias("blocks"), F.sum(F.length("text").cast("long")).alias("chars"))


# --- headings ------------------------------------------------------------------------


def running_texts(blocks: DataFrame) -> DataFrame:
    """(source_id, key): lines that come back on at least 5 pages and 8 % of a source's pages."""
    page = F.struct("shard_ord", "page_idx")
    key = text.running_key("t", numbering.is_structural("t"))
    on = blocks.withColumn("t", strip("text")).select("source_id", key.alias("key"), page.alias("p")).filter("key is not null").distinct().groupBy("source_id", "key").agg(F.count("*").alias("pages"))
    of = blocks.select("source_id", page.alias("p")).distinct().groupBy("source_id").agg(F.count("*").alias("of"))
    return on.join(of, "source_id").filter(F.col("pages") >= F.greatest(F.lit(RUNNING_PAGES), F.floor(F.col("of") * RUNNING_SHARE))).select("source_id", "key", "pages")


def toc_lines(c: Column | str) -> Column:
    """How many lines of a text look like entries of a contents list."""
    lines = F.transform(F.split(text.col(c), "\n"), strip)
    return F.size(F.filter(lines, lambda x: x.rlike(TOC_LINE) | x.rlike(TOC_NUMBERED))).cast("long")


def toc_counts(blocks: DataFrame) -> DataFrame:
    """Per page the lines of text blocks that look like contents entries."""
    return blocks.filter("type = 'text'").groupBy(*PAGE).agg(F.sum(toc_lines("text")).alias("lines"), F.min("gid").alias("first_gid"))


def toc_regions(blocks: DataFrame) -> DataFrame:
    """(source_id, shard_ord, heading_page, last_page): the printed contents list of each source that has one.

    It begins on the page with its heading, or else on the page with most entries (3 at
    least), and goes on while pages have 3 entries, 12 pages at most.
    """
    counts = toc_counts(blocks)
    headed = blocks.filter((F.col("type") == "text") & strip("text").isin(*text.TOC_WORDS)).groupBy("source_id").agg(F.min_by(F.struct("shard_ord", "page_idx"), "gid").alias("headed"))
    busiest = counts.filter(F.col("lines") >= TOC_LEAST_LINES).groupBy("source_id").agg(F.max_by(F.struct("shard_ord", "page_idx"), F.struct("lines", -F.col("first_gid"))).alias("busiest"))
    start = headed.join(busiest, "source_id", "full").select("source_id", F.coalesce("headed", "busiest").alias("s")).select("source_id", F.col("s.shard_ord").alias("shard_ord"), F.col("s.page_idx").alias("heading_page"))
    full = counts.filter(F.col("lines") >= TOC_LEAST_LINES).select("source_id", "shard_ord", "page_idx")
    near = start.join(full, ["source_id", "shard_ord"], "left").filter(F.expr(f"page_idx is null or (page_idx > heading_page and page_idx < heading_page + {TOC_MOST_PAGES})") )
    pages = near.groupBy("source_id").agg(F.sort_array(F.collect_list("page_idx")).alias("pages"))
    reach = F.expr("aggregate(coalesce(pages, cast(array() as array<bigint>)), heading_page, (e, p) -> if(p = e + 1, p, e))")
    return start.join(pages, "source_id", "left").withColumn("last_page", reach).drop("pages")


def heading_candidates(blocks: DataFrame, regions: DataFrame, running: DataFrame, trusted: bool = False) -> DataFrame:
    """Heading candidates with ``marker``, or with ``drop_reason`` and no marker.

    The first reason counts: on a page of the contents list, before it, a caption's fragment on
    a page with figures, not like a heading, noise or undecidable.
    """
    blocks, t = blocks.withColumn("t", strip("text")), F.col("t")
    structural = numbering.any_of(t, numbering.PART, numbering.CHAPTER, numbering.SECTION)
    rows = blocks.filter("type = 'text'")
    figures = rows.filter(t.rlike(text.FIGURE_CAPTION)).select(*PAGE, F.lit(True).alias("figure")).distinct()
    rows = rows.filter((F.coalesce("text_level", F.lit(0)) != 0) | structural).join(figures, list(PAGE), "left")
    rows = rows.join(regions.withColumnRenamed("shard_ord", "toc_shard"), "source_id", "left")
    rows = rows.withColumn("key", text.running_key("t", numbering.is_structural("t"))).join(running.select("source_id", "key", F.lit(True).alias("runs")), ["source_id", "key"], "left")
    same = F.col("shard_ord") == F.col("toc_shard")
    marker = numbering.classify("t", "text_level", F.col("runs"), F.lit(trusted))
    reason = F.when(same & F.col("page_idx").between(F.col("heading_page"), F.col("last_page")), "contents page")
    if not trusted:
        reason = reason.when(same & (F.col("page_idx") < F.col("heading_page")), "front zone")
        reason = reason.when(F.col("figure") & ~numbering.has_numbering("t") & (F.length(t) < FIGURE_FRAGMENT), "caption fragment")
    reason = reason.when(~text.is_plausible_heading("t"), "implausible").when(marker.isNull(), "noise")
    return rows.withColumn("drop_reason", reason).withColumn("marker", F.when(F.col("drop_reason").isNull(), marker)).select("source_id", "gid", "shard_ord", "page_idx", "text", "text_level", "marker", "drop_reason")


def printed_toc(lines: DataFrame) -> DataFrame:
    """Entries (source_id, ord, kind, title, printed) of the contents list's lines(source_id, ord, line).

    A title may stand on the line before its page number; names before the number are not
    the title.
    """
    rows = text.once(lines, line=strip("line")).filter((F.col("line") != "") & ~F.col("line").isin(*text.TOC_WORDS))
    rows = text.once(rows, part=F.col("line").rlike(numbering.PART), numbered=F.col("line").rlike(TOC_PAGE_NUMBER))
    before = F.lag(F.when(~F.col("part") & ~F.col("numbered"), F.col("line"))).over(Window.partitionBy("source_id").orderBy("ord"))
    rows = rows.withColumn("pending", before).filter("part or numbered")
    leaders = F.col("line").rlike(TOC_LEADERS)
    rows = text.once(rows, head=strip(F.when(leaders, F.regexp_replace("line", rf"(?s){TOC_LEADERS}.*\z", "")).otherwise(F.regexp_replace("line", TOC_PAGE_NUMBER, ""))))
    head = F.col("head")
    title = F.when(text.looks_like_authors(head), F.when(F.coalesce("pending", F.lit("")) != "", F.col("pending")).otherwise(head)).when(F.length(head) >= 3, head).otherwise(F.coalesce("pending", F.lit("")))
    rows = text.once(rows, title=title)
    title = strip(F.regexp_replace(text.clean_title("title"), rf"[{SPACE}.．·…\-—–_]+\z", ""))
    rows = text.once(rows, title=F.when(F.col("part"), F.col("line")).otherwise(title)).filter("part or length(title) >= 3")
    printed = F.when(~F.col("part"), F.regexp_extract("line", TOC_PAGE_NUMBER, 2).try_cast("long"))
    return rows.select("source_id", "ord", F.when(F.col("part"), "part").otherwise("chapter").alias("kind"), "title", printed.alias("printed"))


def ranked_tree(candidates: DataFrame) -> DataFrame:
    """Rank and parent of candidates(source_id, seq, marker, unnumbered, in_toc, trusted_level): one fold for each source.

    Plain titles take the rank of the next numbered one, or go below what is open; openings
    and closings do likewise below their chapter; chapters without a number after back matter
    are its sections unless the contents list has them; a contents heading closes what it
    outranks and never is a parent, and neither is the front matter.
    """

    def fold(source: int, rows: list[dict]) -> list[dict]:
        made = fold_ranks([(r["seq"], r["marker"], r["unnumbered"], r["in_toc"], r["trusted_level"]) for r in rows])
        return [{"seq": r["seq"], "rank": rank, "parent_seq": parent} for r, (rank, parent) in zip(rows, made, strict=True)]

    return fold_sources(candidates, ("seq",), fold, "seq long, rank int, parent_seq long")


def placed_tree(candidates: DataFrame) -> DataFrame:
    """The ranked tree of candidates with ``ancestors``, ``parent``, ``depth``, ``ordinal`` and ``nid``, at any depth.

    Built in the same fold from its parents, so it holds for every rank.
    """

    def fold(source: int, rows: list[dict]) -> Iterator[dict]:
        made = fold_ranks([(r["seq"], r["marker"], r["unnumbered"], r["in_toc"], r["trusted_level"]) for r in rows])
        return ({"seq": r["seq"], "rank": rank, **place} for r, (rank, _), place in zip(rows, made, fold_places([(r["seq"], parent) for r, (_, parent) in zip(rows, made, strict=True)]), strict=True))

    return fold_sources(candidates, ("seq",), fold, "seq long, rank int, ancestors array<long>, parent long, depth long, ordinal long, nid string")


def fold_places(rows: list[tuple[int, int | None]]) -> Iterator[dict]:
    """Where each of rows (seq, parent) in document order stands in the tree; parents come first."""
    chain: list[tuple[int, str]] = []
    children: dict[int | None, int] = {}
    for seq, parent in rows:
        while chain and chain[-1][0] != parent:
            chain.pop()
        children[parent] = ordinal = children.get(parent, 0) + 1
        nid = f"{chain[-1][1]}.{ordinal}" if chain else str(ordinal)
        yield {"ancestors": [s for s, _ in chain], "parent": parent, "depth": len(chain) + 1, "ordinal": ordinal, "nid": nid}
        chain.append((seq, nid))


def fold_ranks(rows: list[tuple]) -> list[tuple[int, int | None]]:
    """(rank, parent) for rows (seq, marker, unnumbered, in_toc, trusted_level) in document order."""
    ranks, numbered, chapterlike = numbering.RANK, set(numbering.NUMBERED), set(numbering.CHAPTER_RANKED)
    plain_next: list[int | None] = [None] * len(rows)
    held_next: list[int | None] = [None] * len(rows)
    for_plain = for_held = None
    for k in range(len(rows) - 1, -1, -1):  # what the next deciding marker says
        plain_next[k], held_next[k] = for_plain, for_held
        marker = rows[k][1]
        if marker in numbered:
            for_plain = for_held = ranks[marker]
        elif marker in chapterlike:
            for_plain = for_held = None
        elif marker in ("opening", "closing"):
            for_held = None
    open_: list[tuple[int, int]] = []
    after_back, out = False, []
    for k, (seq, marker, unnumbered, in_toc, trusted) in enumerate(rows):
        if marker == "plain":
            if trusted and trusted > 0:
                rank = 20 + (int(trusted) - 1) * 10
            else:
                rank = plain_next[k] or (open_[-1][0] + 5 if open_ else 20)
        elif marker in ("opening", "closing"):
            chapter = next((r for r, _ in reversed(open_) if r <= 20), 20)
            rank = held_next[k] or chapter + 20
        else:
            rank = ranks[marker]
        after_back = after_back or marker == "backmatter"
        if after_back and marker == "chapter" and unnumbered and not in_toc:
            rank = ranks["sec"]
        while open_ and open_[-1][0] >= rank:
            open_.pop()
        out.append((rank, open_[-1][1] if open_ else None))
        if marker not in ("toc", "front"):
            open_.append((rank, seq))
    return out


def greedy_matches(nodes: list[tuple], entries: list[tuple], short_equal: bool) -> list[tuple]:
    """(node id, entry id) of nodes(id, key) and entries(id, key), in order; an entry is taken once.

    Keys match if one holds the other and both have at least 4 characters; shorter ones match
    if equal, where that is asked for.
    """
    left, out = list(entries), []
    for node, key in nodes:
        for k, (entry, other) in enumerate(left):
            short = min(len(key), len(other)) < 4
            if (key and short and short_equal and key == other) or (not short and (key in other or other in key)):
                out.append((node, entry))
                del left[k]
                break
    return out


def matched_entries(nodes: DataFrame, entries: DataFrame, short_equal: bool = True) -> DataFrame:
    """(source_id, seq, ord): the greedy match of nodes(source_id, seq, key) with entries(source_id, ord, key)."""
    both = nodes.select("source_id", F.lit(0).alias("side"), "seq", "key").unionByName(entries.select("source_id", F.lit(1).alias("side"), F.col("ord").alias("seq"), "key"))

    def fold(source: int, rows: list[dict]) -> list[dict]:
        own, toc = ([(r["seq"], r["key"]) for r in rows if r["side"] == side] for side in (0, 1))
        return [{"seq": a, "ord": b} for a, b in greedy_matches(own, toc, short_equal)]

    return fold_sources(both, ("side", "seq"), fold, "seq long, ord long")


def misread_entries(entries: DataFrame) -> DataFrame:
    """Contents entries(source_id, ord, printed) whose number falls more than 3 below the last accepted one."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "printed")))
    rows = entries.filter("printed is not null").groupBy("source_id").agg(listed.alias("e"))
    step = """aggregate(e, named_struct('prev', cast(null as bigint), 'bad', cast(array() as array<bigint>)),
        (a, x) -> if(a.prev is not null and x.printed < a.prev - 3, named_struct('prev', a.prev, 'bad', concat(a.bad, array(x.ord))), named_struct('prev', x.printed, 'bad', a.bad)), a -> a.bad)"""
    return rows.select("source_id", F.explode(F.expr(step)).alias("ord"))


def entry_matches(key: str, title: str) -> bool:
    """Whether a title says an entry: short keys if equal, others if one holds the other or the entry goes on from the title."""
    if len(key) < 4:
        return key == title
    return (len(title) >= 4 and (key in title or title in key)) or (len(title) >= 2 and key.startswith(title))


def repaired_entries(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """(source_id, ord, status) of the chapter entries of a contents list that no title matches: what a repair adds or passes over.

    entries(source_id, ord, kind, title, printed, page_known, gid) say on which page and first
    block they lie. An added entry is a title from then on, so a later one that it matches
    isn't added; one without a page or a block is passed over and isn't a title.
    """
    e = entries.filter("kind = 'chapter' and printed is not null and printed <> 0").select("source_id", F.lit(1).alias("side"), "ord", text.contents_key("title").alias("key"), "page_known", "gid")
    t = titles.select("source_id", F.lit(0).alias("side"), F.lit(0).cast("long").alias("ord"), text.contents_key(text.clean_title("title")).alias("key")).distinct()

    def fold(source: int, rows: list[dict]) -> Iterator[dict]:
        known = [r["key"] for r in rows if not r["side"] and r["key"]]
        for r in rows:
            if not r["side"] or not r["key"] or any(entry_matches(r["key"], k) for k in known):
                continue
            status = "no page" if not r["page_known"] else "no block" if r["gid"] is None else "added"
            if status == "added":
                known.append(r["key"])
            yield {"ord": r["ord"], "status": status}

    return fold_sources(t.unionByName(e, allowMissingColumns=True), ("side", "ord", "key"), fold, "ord long, status string")


def missing_entries(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """Chapter entries of a contents list that neither a title nor an entry before them matches, were every page known."""
    found = repaired_entries(entries.withColumn("page_known", F.lit(True)).withColumn("gid", F.lit(0).cast("long")), titles)
    return entries.join(found.select("source_id", "ord"), ["source_id", "ord"]).select("source_id", "ord", "title", "printed")


def first_blocks(pages: DataFrame, blocks: DataFrame, reach: int = 4) -> DataFrame:
    """pages(source_id, shard_ord, page_idx) with the first block of the first page, of at most ``reach``, that has one."""
    firsts = blocks.groupBy(*PAGE).agg(F.min("gid").alias("gid")).withColumnRenamed("page_idx", "at")
    probes = pages.distinct().withColumn("at", F.explode(F.sequence("page_idx", F.col("page_idx") + reach - 1)))
    found = probes.join(firsts, ["source_id", "shard_ord", "at"]).groupBy(*PAGE).agg(F.min_by("gid", "at").alias("gid"))
    return pages.join(found, list(PAGE), "left")


def any_column(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
