"""Rendering sections: which blocks go into which file, page anchors, notes, names, manifests."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.functions.text import col, is_noise_text, safe_filename, strip
from quire.operators.folds import fold_sources

NAME_MOST = 100
FIXED_DATE = (2010, 1, 1, 0, 0, 0)
FOOTNOTES = ("page-end", "inline", "drop")


def pieces(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """Parts of blocks(source_id, gid, text, ..) by the marks(source_id, gid, offset, file) that cut them.

    A file runs from its mark to the next one; a mark inside a block cuts its text. ``file`` is
    null before the first mark; ``part`` numbers the parts of a block. A part of blanks is
    left out, unless it is the whole block.
    """
    inner = marks.filter("offset > 0").groupBy("source_id", "gid").agg(F.array_sort(F.collect_list(F.struct(F.col("offset").alias("o"), F.col("file").alias("f")))).alias("cuts"))
    at = marks.groupBy("source_id", "gid").agg(F.max_by("file", "offset").alias("last_file"), F.max_by("file", F.when(F.col("offset") == 0, 1)).alias("start_file"))
    rows = blocks.join(inner, ["source_id", "gid"], "left").join(at, ["source_id", "gid"], "left")
    w = Window.partitionBy("source_id").orderBy("gid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.last("last_file", True).over(w))
    head = F.struct(F.lit(0).cast("long").alias("o"), F.coalesce("start_file", "before").alias("f"))
    rows = rows.withColumn("cuts", F.concat(F.array(head), F.coalesce("cuts", F.array().cast("array<struct<o:bigint,f:bigint>>"))))
    ends = F.expr("transform(cuts, (c, i) -> named_struct('file', c.f, 'start', least(c.o, length(text)), 'stop', if(i + 1 < size(cuts), least(cuts[i + 1].o, length(text)), length(text)), 'part', i))")
    whole = (F.size("cuts") == 1) | ((F.length("text") == 0) & (F.col("x.part") == 0))
    out = rows.withColumn("x", F.explode(ends)).withColumn("piece", F.expr("substring(text, cast(x.start + 1 as int), cast(x.stop - x.start as int))")).filter(whole | (strip("piece") != ""))
    return out.select(*[c for c in blocks.columns if c != "text"], F.col("x.file").alias("file"), F.col("x.part").alias("part"), F.col("piece").alias("text"))


def with_fields(blocks: DataFrame) -> DataFrame:
    """blocks with img_path, table_body, caption and footnote, empty where the table has none."""
    none = {"img_path": F.lit(""), "table_body": F.lit(""), "caption": F.array().cast("array<string>"), "footnote": F.array().cast("array<string>")}
    return blocks.withColumns({c: F.coalesce(F.col(c), v) if c in blocks.columns else v for c, v in none.items()})


def body_lines() -> Column:
    """The lines of a block by its type: text as it is, pictures and tables with captions and notes."""
    no = F.array().cast("array<string>")
    t, kind = F.col("text"), F.col("type")
    caption = F.array_join("caption", "；")
    name = F.when(F.col("img_path") != "", F.concat(F.lit("images/"), F.regexp_extract("img_path", r"([^/\\]*)\z", 1))).otherwise("")
    notes = F.transform("footnote", lambda x: F.concat(F.lit("> "), x))
    picture = F.concat(F.array(F.concat(F.lit("!["), caption, F.lit("]("), name, F.lit(")"))), F.when(caption != "", F.array(F.concat(F.lit("*"), caption, F.lit("*")))).otherwise(no), notes)
    titles = F.transform("caption", lambda x: F.concat(F.lit("**"), x, F.lit("**")))
    table = F.concat(titles, F.when(F.col("table_body") != "", F.array("table_body")).otherwise(no), notes)
    plain = F.when(F.when(kind == "text", strip(t) != "").otherwise((t != "") | kind.isin("equation", "interline_equation")), F.array(t)).otherwise(no)
    return F.when(kind.isin("image", "chart"), picture).when(kind == "table", table).otherwise(plain)


def rendered_lines(parts: DataFrame, footnotes: str = "page-end") -> DataFrame:
    """Lines (source_id, file, page_run, kind_order, gid, part, k, line) of parts with ``anchor`` texts of their pages.

    An anchor line (kind 0) comes before the first block of every page; notes come at their
    page's end under a heading (kind 2), inline or not at all. Layout noise is left out.
    """
    if footnotes not in FOOTNOTES:
        raise ValueError(f"footnotes is one of {FOOTNOTES}")
    shown = with_fields(parts).filter(~F.col("type").isin(*text.NOISE_TYPES) & ~is_noise_text("text"))
    w = Window.partitionBy("source_id", "file").orderBy("gid", "part")
    page = F.struct("shard_ord", "page_idx")
    turns = F.when(F.coalesce(page != F.lag(page).over(w), F.lit(True)), 1).otherwise(0)
    rows = shown.withColumn("turns", turns).withColumn("page_run", F.sum("turns").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    note = F.col("type") == "page_footnote"
    first = F.row_number().over(Window.partitionBy("source_id", "file", "page_run", note).orderBy("gid", "part")) == 1
    heading = F.array(F.lit(""), F.concat(F.lit("**脚注**（P"), F.col("shard_ord"), F.lit(" 物理页 "), F.col("page_idx"), F.lit("）：")))
    item = F.array(F.concat(F.lit("- "), F.col("text")))
    noted = {"page-end": F.when(F.col("first"), F.concat(heading, item)).otherwise(item), "inline": F.array(F.concat(F.lit("<!-- footnote --> "), F.col("text"))), "drop": F.array().cast("array<string>")}[footnotes]
    rows = rows.withColumn("first", first).withColumn("lines", F.when(note, noted).otherwise(body_lines()))
    order = F.when(note & F.lit(footnotes == "page-end"), 2).otherwise(1)
    anchors = rows.filter("turns = 1").select("source_id", "file", "page_run", F.lit(0).alias("kind_order"), "gid", "part", F.lit(0).alias("k"), F.col("anchor").alias("line"))
    return anchors.unionByName(rows.select("source_id", "file", "page_run", order.alias("kind_order"), "gid", "part", F.posexplode("lines").alias("k", "line")))


def documents(lines: DataFrame) -> DataFrame:
    """(source_id, file, content): lines joined in order."""
    order = F.struct("page_run", "kind_order", "gid", "part", "k", "line")
    listed = F.array_sort(F.collect_list(order))
    return lines.groupBy("source_id", "file").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("content"))


def sections(files: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """files(source_id, file, content) as whole section texts.

    nodes(source_id, file, nid, title, crumbs, locator_type, gid_first, gid_last, shard_ord,
    page_idx) say what a section is: comments with its origin, its title, where it belongs.
    """
    rows = nodes.join(files, ["source_id", "file"], "left")
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.concat(F.lit("节点"), F.col("nid")))
    origin = F.concat(F.lit("<!-- quire | source="), F.col("source_id"), F.lit(" | node="), F.col("nid"), F.lit(f" | depth={depth} | locator_type="), F.col("locator_type"), F.lit(" -->"))
    span = F.concat(F.lit("<!-- source_range: gid "), F.col("gid_first"), F.lit("-"), F.col("gid_last"), F.lit(" | shard P"), F.col("shard_ord"), F.lit(" p"), F.col("page_idx"), F.lit(" -->"))
    belongs = F.when((F.coalesce("crumbs", F.lit("")) != "") & F.lit(depth != 0), F.concat(F.lit("\n> 归属："), F.col("crumbs"), F.lit("\n"))).otherwise("")
    body = F.when(F.coalesce("content", F.lit("")) != "", F.concat(F.lit("\n"), F.col("content"))).otherwise("")
    text_ = F.concat(origin, F.lit("\n"), span, F.lit("\n# "), title, F.lit("\n"), belongs, body, F.lit("\n"))
    return rows.select("source_id", "file", text_.alias("content"))


def indexed_fields(parts: DataFrame) -> DataFrame:
    """(source_id, file, gid, text): what of the content blocks a file must hold, field by field of the source."""
    rows = with_fields(parts).filter(text.is_content("type") & ~is_noise_text("text"))
    kind = F.col("type")
    table = F.concat("caption", F.array("table_body"), "footnote")
    fields = F.when(kind.isin("image", "chart"), F.concat("caption", "footnote")).when(kind == "table", table).otherwise(F.array("text"))
    return rows.select("source_id", "file", "gid", F.explode(fields).alias("text"))


def render_stats(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Per source: anchors, those of pages without a locator, notes, pictures and tables shown."""
    told = lines.groupBy("source_id").agg(
        F.count_if(F.col("kind_order") == 0).alias("anchors"), F.count_if((F.col("kind_order") == 0) & F.col("line").contains("unmapped")).alias("unmapped"),
        F.count_if((F.col("kind_order") == 2) & F.col("line").startswith("- ")).alias("footnotes"),
    )
    shown = parts.filter(~F.col("type").isin(*text.NOISE_TYPES) & ~is_noise_text("text")).groupBy("source_id")
    kinds = shown.agg(F.count_if(F.col("type").isin("image", "chart")).alias("images"), F.count_if(F.col("type") == "table").alias("tables"))
    return told.join(kinds, "source_id")


def file_stats(parts: DataFrame) -> DataFrame:
    """Per file: blocks, characters, images, notes, noise left out, range of blocks, pages without a locator."""
    noise = F.col("type").isin(*text.NOISE_TYPES) | is_noise_text("text")
    content = text.is_content("type") & ~noise
    return parts.groupBy("source_id", "file").agg(
        F.count_if(content).alias("blocks"), F.coalesce(F.sum(F.when(content, F.length("text"))), F.lit(0)).cast("long").alias("chars"), F.count_if(F.col("type").isin("image", "chart")).alias("images"),
        F.count_if(F.col("type") == "page_footnote").alias("notes"), F.count_if(noise).alias("noise_dropped"), F.min("gid").alias("gid_first"), F.max("gid").alias("gid_last"),
        F.count_distinct(F.when(~noise, F.struct("shard_ord", "page_idx"))).alias("pages"),
    )


def conversion_meta(blocks: DataFrame, outputs: DataFrame) -> DataFrame:
    """(source_id, meta): the JSON of what a conversion holds: counters, how many files, and where each shard's pages begin."""
    t = F.col("type")
    own = blocks.groupBy("source_id").agg(
        F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"), F.count_if(t.isin("image", "chart")).alias("images"), F.count_if(t == "table").alias("tables"), F.count_if(t == "page_footnote").alias("notes"),
    )
    shards = blocks.groupBy("source_id", "shard_ord").agg((F.max("page_idx") + 1).alias("pages"), F.count("*").alias("n"))
    before = Window.partitionBy("source_id").orderBy("shard_ord").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("first_page", F.coalesce(F.sum("pages").over(before), F.lit(0)))
    one = F.struct(F.concat(F.lit("P"), F.col("shard_ord")).alias("tag"), "pages", F.col("n").alias("blocks"), "first_page")
    listed = shards.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard_ord", one.alias("x")))), lambda s: s["x"]).alias("shards"))
    rows = own.join(outputs, "source_id", "left").join(listed, "source_id").withColumn("outputs", F.coalesce("outputs", F.lit(0)))
    return rows.select("source_id", F.to_json(F.struct("blocks", "chars", "images", "tables", "notes", "outputs", "shards")).alias("meta"))


def file_name(seq: Column | str, crumbs: Column | str, title: Column | str) -> Column:
    """``007_Part_Chapter.md``: the chain of titles, outermost ancestors dropped until it fits."""

    def chained(parts: Column) -> Column:
        whole = F.array_join(parts, "_")
        fit = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "_")), lambda s: F.length(s) <= NAME_MOST)
        return F.when(F.length(whole) <= NAME_MOST, whole).otherwise(F.coalesce(F.try_element_at(fit, F.lit(1)), F.substring(F.element_at(parts, -1), 1, NAME_MOST)))

    parts = F.transform(F.concat(col(crumbs), F.array(col(title))), lambda x: safe_filename(x, NAME_MOST))
    stem = F.element_at(F.transform(F.array(parts), chained), 1)  # as a lambda's argument, names are made once
    return F.concat(F.lpad(col(seq).cast("string"), 3, "0"), F.lit("_"), stem, F.lit(".md"))


def only_page(lines: DataFrame, locator: str) -> DataFrame:
    """Of lines(source_id, file, ord, line), those between a page's anchor and the next one."""
    w = Window.partitionBy("source_id", "file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    on = F.when(F.col("line").rlike(r"^<!-- p=.* -->\z"), F.regexp_extract("line", r"^<!-- p=([^ ]*)", 1))
    return lines.withColumn("on", F.last(on, True).over(w)).filter(F.col("on") == locator).drop("on")


def stale_files(listed: DataFrame, produced: DataFrame) -> DataFrame:
    """Files of our own naming(source_id, path) that this run did not produce."""
    return listed.filter(F.col("path").rlike(r"^[0-9]{3,}_.+\.md\z")).join(produced, ["source_id", "path"], "left_anti")


def is_inside(path: Column | str) -> Column:
    """Whether a relative path stays below the folder it is asked from."""
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    return (p != "") & ~p.startswith("/") & ~p.rlike(r"^[A-Za-z]:") & ~F.concat(F.lit("/"), p, F.lit("/")).contains("/../")


def bundles(files: DataFrame) -> DataFrame:
    """(source_id, archive, entries): the files(source_id, path, content) of each source as one archive, to be downloaded.

    Paths that lead outside are left out; equal files give equal archives.
    """

    def fold(source: int, rows: list[dict]) -> list[dict]:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for r in rows:
                z.writestr(zipfile.ZipInfo(r["path"], FIXED_DATE), r["content"] or "", zipfile.ZIP_DEFLATED)
        return [{"archive": out.getvalue(), "entries": len(rows)}]

    return fold_sources(files.filter(is_inside("path")).select("source_id", "path", "content"), ("path",), fold, "archive binary, entries long")


def images_used(references: DataFrame, files: DataFrame) -> DataFrame:
    """references(source_id, name) with the first shard that has the image; null if none has."""
    found = files.groupBy("source_id", "name").agg(F.min("shard_ord").alias("shard_ord"))
    return references.distinct().join(found, ["source_id", "name"], "left")
