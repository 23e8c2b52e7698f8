"""The stand-alone converter: packages to chapters by their own contents lists and heading levels, without an outline.

Files are grouped into chapters in reading order, index-like tails are cut off and put
together, and each chapter is one Markdown text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import W, col, strip
from quire.operators.folds import fold_sources

#: Titles that begin a chapter, titles that cut a file, the class of titles whose chapters are one, note marks.
CHAPTER = (
    r"^(第\s*[0-9一二三四五六七八九十百]+\s*[章篇部讲]|前言|序言|序【|导论|导言|引言|绪论|后记|译后记|译序|再版|增订|献\s*辞|题辞|题词|体例|凡例|出版说明|中译本|法文版|德文版|英文版"
    r"|附录[一二三四五六七八九十0-9]|索引|术语索引|人名|地名|引用作品|参考文献|年表|Chapter|Preface|Introduction|Afterword|Appendix|Index|Notes|Bibliography)"
)
SPLIT = r"^(关键词|索引|术语索引|人名地名|人名索引|主题索引|引用作品|参考文献)"
INDEX_CLASS = "关键词|索引|术语|人名|地名|引用作品|参考文献"
MARKS = "①②③④⑤⑥⑦⑧⑨⑩"
NORM = rf"[{MARKS}*·•．. 　\t\n\r\x0b\x0c]"
CJK = "一-鿿"


def plain(c: Column | str) -> Column:
    """A title without note marks, emphasis, dots and blanks, for comparing."""
    return F.regexp_replace(col(c), NORM, "")


def title(c: Column | str) -> Column:
    """A title as it is printed: blanks squeezed, note marks at the end gone, one blank after a chapter's number."""
    t = strip(F.regexp_replace(col(c), f"{W}+", " "))
    t = strip(F.regexp_replace(t, rf"[{MARKS}]+\z", ""))
    t = F.regexp_replace(t, rf"(?<=[{CJK}]) (?=[{CJK}])", "")
    t = F.regexp_replace(t, rf"^(第ws*[0-9一二三四五六七八九十百]+ws*[章节篇部卷辑])(?=[{CJK}A-Za-z])".replace("ws", W), "$1 ")
    return strip(F.regexp_replace(t, rf"^(附录[0-9一二三四五六七八九十]+)(?=[{CJK}])", "$1 "))


def file_name(c: Column | str) -> Column:
    """A title as a file name: reserved characters gone, blanks to hyphens."""
    return F.regexp_replace(F.regexp_replace(strip(c), r'[\\/:*?"<>|]', ""), f"{W}+", "-")


def is_index(c: Column | str) -> Column:
    """Whether a title is of an index, so that it goes with the one before it."""
    return plain(c).rlike(INDEX_CLASS)


def together(a: str, b: str) -> str:
    """The title of two indexes in one chapter."""
    a, b = (re.sub(r"^(索引|关键词索引)\s*", "", t.strip()) for t in (a, b))
    if not a or a == b:
        return b
    return "索引 " + "·".join(dict.fromkeys(f"{a}·{b}".split("·")))


def files_of(items: DataFrame, labels: DataFrame) -> DataFrame:
    """(source_id, unit, label, starts, cut, cut_title, n): the files of items(source_id, unit, ord, kind, text) that have headings.

    labels(source_id, unit, label) are of the contents list; where a source has any, only
    labelled files count. A file starts a chapter if its label or first heading looks like
    one, or if its first heading is of the level that most files begin with. ``cut`` is the
    place of the first later heading that begins an index.
    """
    heads = items.filter(F.col("kind").rlike(r"^h[1-6]\z")).withColumn("level", F.substring("kind", 2, 1).cast("int"))
    first = heads.groupBy("source_id", "unit").agg(F.min_by(F.struct("ord", "level", "text"), "ord").alias("h"))
    index = heads.filter(plain("text").rlike(SPLIT)).join(first.select("source_id", "unit", F.col("h.ord").alias("first_ord")), ["source_id", "unit"]).filter("ord > first_ord")
    cuts = index.groupBy("source_id", "unit").agg(F.min_by(F.struct("ord", "text"), "ord").alias("c"))
    rows = first.join(labels, ["source_id", "unit"], "left").join(cuts, ["source_id", "unit"], "left").join(items.groupBy("source_id", "unit").agg(F.count("*").alias("n")), ["source_id", "unit"])
    rows = rows.withColumn("any", F.max(F.col("label").isNotNull()).over(Window.partitionBy("source_id"))).filter("label is not null or not any")
    by = rows.groupBy("source_id", F.col("h.level").alias("level")).agg(F.count("*").alias("k"))
    usual = by.groupBy("source_id").agg(F.min_by("level", F.struct(-F.col("k"), "level")).alias("usual"))
    label = F.coalesce("label", "h.text")
    starts = plain(label).rlike(CHAPTER) | plain("h.text").rlike(CHAPTER) | (F.col("h.level") == F.col("usual"))
    return rows.join(usual, "source_id").select("source_id", "unit", label.alias("label"), starts.alias("starts"), F.col("c.ord").alias("cut"), F.col("c.text").alias("cut_title"), "n")


def chapter_groups(files: DataFrame) -> DataFrame:
    """(source_id, chapter, title, unit, first, past): which items of which files make up each chapter, in order.

    A file that starts nothing goes with the chapter before it; indexes in a row are one.
    """

    def fold(source: int, rows: list[dict]) -> Iterator[dict]:
        groups: list[list] = []

        def push(name: str, part: tuple) -> None:
            if groups and _index(name) and _index(groups[-1][0]):
                groups[-1][0] = together(groups[-1][0], name)
                groups[-1][1].append(part)
            else:
                groups.append([name, [part]])

        for r in rows:
            end = r["n"] if r["cut"] is None else r["cut"]
            if groups and not r["starts"]:
                groups[-1][1].append((r["unit"], 0, end))
            else:
                push(r["label"], (r["unit"], 0, end))
            if r["cut"] is not None:
                push(r["cut_title"], (r["unit"], end, r["n"]))
        for k, (name, parts) in enumerate(groups):
            for unit, first, past in parts:
                yield {"chapter": k + 1, "title": name, "unit": unit, "first": first, "past": past}

    return fold_sources(files, ("unit",), fold, "chapter long, title string, unit long, first long, past long")


def _index(name: str) -> bool:
    return bool(re.search(INDEX_CLASS, re.sub(NORM, "", name)))


def chapter_map(groups: DataFrame) -> DataFrame:
    """(source_id, chapter, title, sources): the map of chapters, each part as file[first:past]."""
    part = F.concat(F.col("unit"), F.lit("["), F.col("first"), F.lit(":"), F.col("past"), F.lit("]"))
    listed = F.array_sort(F.collect_list(F.struct("unit", "first", part.alias("p"))))
    return groups.groupBy("source_id", "chapter", "title").agg(F.array_join(F.transform(listed, lambda x: x["p"]), " + ").alias("sources"))


def chapter_texts(items: DataFrame, groups: DataFrame) -> DataFrame:
    """(source_id, chapter, title, content): each chapter as Markdown; headings at its beginning that repeat its title are left out."""
    rows = groups.join(items, ["source_id", "unit"]).filter("ord >= first and ord < past").withColumn("title", title("title"))
    kind, t = F.col("kind"), F.col("text")
    head = kind.rlike(r"^h[1-6]\z")
    same = kind.rlike(r"^h[1-3]\z") & (plain(t) == plain("title"))
    w = Window.partitionBy("source_id", "chapter").orderBy("unit", "ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("body", F.max(~same).over(w)).filter("body")
    shown = (
        F.when(kind == "note", F.concat(F.lit("> "), F.replace(t, F.lit("\n"), F.lit("\n> ")), F.lit("\n"))).when(kind == "edge", F.concat(F.lit("`"), t, F.lit("`\n"))).when(kind == "hr", F.lit("---\n"))
        .when(kind == "tr", F.concat(F.lit("| "), t, F.lit(" |"))).when(head, F.concat(F.repeat(F.lit("#"), F.substring(kind, 2, 1).cast("int")), F.lit(" "), t, F.lit("\n")))
        .when(kind.startswith("li."), F.concat(F.lit("- "), F.regexp_replace(t, rf"{W}*\n{W}*", " "))).otherwise(F.concat(F.when(F.col("quoted"), "> ").otherwise(""), F.replace(t, F.lit("\n"), F.lit("  \n")), F.lit("\n")))
    )
    listed = F.array_sort(F.collect_list(F.struct("unit", "ord", shown.alias("s"))))
    by = rows.groupBy("source_id", "chapter", "title").agg(F.array_join(F.transform(listed, lambda x: x["s"]), "\n").alias("s"))
    whole = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("s"))
    tidy = F.regexp_replace(F.regexp_replace(whole, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n")
    return by.select("source_id", "chapter", "title", F.concat(strip(tidy), F.lit("\n")).alias("content"))
