"""Lenient HTML to a sequence of items: headings, paragraphs, notes, edge codes, lists, tables, images.

A document is read into elements by a few tolerance rules (void tags don't count, a new
paragraph closes an open one, an end tag closes up to its match), and an emitter turns the
elements of its body into items in reading order.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.session import ship

#: Tags without content, marks of notes, codes of page edges, and text classes.
VOID = frozenset("meta link br hr wbr input area base col source track".split())
CIRCLED = frozenset("①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳")
CJK = "㐀-䶿一-鿿"
PUNCTUATION = "，。、；：！“”‘’（）《》〈〉【】—…·"
EDGE = re.compile(r"^[FE](?:\d{1,4}|[IVXLCDM]{1,7})$", re.I)
QUOTED_EDGE = re.compile(r"`[FfEe][0-9IVXLCDM]{1,7}`")
SENTENCE_ENDS, CLOSERS = "。！？…", "）)”』】》\"'.!?"
BRACKETS = (("(", ")"), ("［", "］"), ("[", "]"), ("【", "】"))
SKIPPED = frozenset("script style head svg title meta".split())
CONTAINERS = frozenset("section article main aside header footer figure".split())


class Item(NamedTuple):
    kind: str
    text: str
    quoted: bool


@dataclass
class Element:
    tag: str
    attributes: dict = field(default_factory=dict)
    parts: list = field(default_factory=list)

    def elements(self, *tags: str) -> list[Element]:
        return [p for p in self.parts if isinstance(p, Element) and (not tags or p.tag in tags)]


class _Reader(HTMLParser):
    """Elements by open path; texts outside of any element don't count."""

    CLOSES = {"p": ("p",), "li": ("li", "p")}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = Element("")
        self.path: list[Element] = []
        self.body: Element | None = None

    def _add(self, tag: str, attributes: list) -> Element:
        made = Element(tag, dict(attributes))
        (self.path[-1] if self.path else self.top).parts.append(made)
        if tag == "body" and self.body is None:
            self.body = made
        return made

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        if self.path and self.path[-1].tag in self.CLOSES.get(tag, ()):
            self.path.pop()
        made = self._add(tag, attrs)
        if tag != "img":
            self.path.append(made)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag == "img":
            self._add(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        depths = [k for k, e in enumerate(self.path) if k and e.tag == tag]
        if depths and tag not in VOID:
            del self.path[depths[-1] :]

    def handle_data(self, data: str) -> None:
        if data and self.path:
            self.path[-1].parts.append(data)


def body_of(markup: str) -> Element:
    reader = _Reader()
    reader.feed(markup)
    return reader.body or reader.top


#: How a text is tidied, in this order.
TIDY = tuple(
    (re.compile(pattern), to)
    for pattern, to in (
        (r"[​-‏‪-‮-﻿]", ""),
        (r"[    ]", " "),
        (r"\r", "\n"),
        (r"[ \t]+", " "),
        (r" *\n *", "\n"),
        (r"\n{2,}", "\n"),
        (rf"(?<=[{CJK}{PUNCTUATION}])\s+(?=[{CJK}{PUNCTUATION}])", ""),
        (rf"^([0-9]{{1,2}})[ ,.．]\s*(?=[{CJK}])", r"\1. "),
        (rf"(?<=[{CJK}]) (?=[A-Za-z(])", ""),
        (rf"(?<=[A-Za-z)]|[,.\-]) (?=[{CJK}])", " "),
        (rf"(?<![A-Za-z0-9])([FfEe](?:\d{{1,4}}|[IVXLCDMivxlcdm]{{2,7}}))[ \t]*(?=[{CJK}])", r"`\1` "),
        (rf"(?m)^([FfEe](?:\d{{1,4}}|[IVXLCDM]{{2,7}}))[ \t]+(?=[{CJK}A-Z])", r"`\1` "),
        (r"<", "&lt;"),
        (r"(?m)^>", "&gt;"),
    )
)


def tidy(text: str) -> str:
    text = html.unescape(text)
    for pattern, to in TIDY:
        text = pattern.sub(to, text)
    return text.strip()


def tidied(texts: DataFrame) -> DataFrame:
    """texts(source_id, text) with their text tidied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tidy(t or "") for t in b.column(1).to_pylist()], pa.string())], ["source_id", "text"])

    ship(texts.sparkSession)
    return texts.select("source_id", "text").mapInArrow(run, "source_id long, text string")


def flat(part: Element | str) -> str:
    """Inline text: emphasis as Markdown, no subscripts, superscripts only if they number something."""
    if isinstance(part, str):
        return part
    inner = "".join(map(flat, part.parts))
    core = " ".join(inner.split())
    match part.tag:
        case "sub" | "img":
            return ""
        case "sup":
            return inner if re.search(r"\d", core) or core.startswith("[") else ""
        case "i" | "em":
            return f"*{core}*" if core and set(core) - CIRCLED else inner
        case "b" | "strong":
            return f"**{core}**" if core else inner
    return inner


def line(element: Element) -> str:
    return tidy(flat(element))


def is_note(text: str) -> bool:
    return text[:1] in CIRCLED if text else False


def items(markup: str) -> list[Item]:
    """The items of a document, in reading order."""
    return list(_emit(body_of(markup), False))


def _emit(parent: Element, quoted: bool) -> Iterator[Item]:
    for part in parent.parts:
        if isinstance(part, str):
            kind, text = "p", tidy(part)
        elif part.tag in SKIPPED:
            continue
        elif part.tag == "blockquote" or part.tag in CONTAINERS:
            yield from _emit(part, quoted or part.tag == "blockquote")
            continue
        elif part.tag in ("ul", "ol"):
            yield from _emit_list(part, quoted)
            continue
        elif part.tag == "table":
            yield from (Item("tr", row, quoted) for row in table_rows(part))
            continue
        elif part.tag == "div" and not (codes := edge_codes(part)):
            yield from _emit(part, quoted)
            continue
        elif part.tag == "div":
            kind, text = "edge", " · ".join(codes)
        elif part.tag == "img":
            kind, text = "img", (part.attributes.get("src") or "").strip()
        elif re.fullmatch("h[1-6]", part.tag):
            kind, text = part.tag, line(part)
        else:
            kind, text = "p", line(part)
            if part.tag == "p" and (EDGE.match(text) or QUOTED_EDGE.fullmatch(text)):
                kind, text = "edge", text.strip("`")
            elif part.tag == "p" and is_note(text):
                kind = "note"
        if text:
            yield Item(kind, text, quoted)


def edge_codes(element: Element) -> list[str]:
    """The codes of an element that holds nothing but paragraphs with page-edge codes."""
    paragraphs = element.elements("p")
    codes = [line(p).replace(" ", "") for p in paragraphs]
    whole = paragraphs and len(paragraphs) == len(element.elements()) and all(map(EDGE.match, codes))
    return codes if whole else []


def _emit_list(element: Element, quoted: bool) -> Iterator[Item]:
    bare = "list-style:none" in (element.attributes.get("style") or "").replace(" ", "").lower()
    for entry in element.elements("li"):
        inner = list(_emit(entry, quoted))
        if bare and inner and is_note(inner[0].text):
            yield Item("note", "\n".join(i.text for i in inner), quoted)
        else:
            yield from (i if bare else i._replace(kind=f"li.{i.kind}") for i in inner)


def table_rows(table: Element) -> list[str]:
    """Pipe rows with a separator after the first; short rows are filled up."""
    lines = [r for part in table.elements("tr", "thead", "tbody", "tfoot") for r in ([part] if part.tag == "tr" else part.elements("tr"))]
    rows = [r for r in ([tidy(flat(c)).replace("\n", " ") for c in tr.elements("td", "th")] for tr in lines) if r]
    if not rows:
        return []
    width = max(map(len, rows))
    filled = [" | ".join(r + [""] * (width - len(r))) for r in rows]
    return [filled[0], "|".join(["---"] * width), *filled[1:]]


# --- paragraphs that pages cut -----------------------------------------------------------


def unclosed(text: str, pairs: tuple = BRACKETS) -> bool:
    return any(text.count(a) > text.count(b) for a, b in pairs)


def is_cut(text: str) -> bool:
    """A paragraph that may go on: an open bracket, or no sentence end."""
    return len(text) >= 8 and (unclosed(text) or text[-1] not in SENTENCE_ENDS + CLOSERS)


def is_surely_cut(text: str) -> bool:
    return bool(text) and (unclosed(text, (*BRACKETS, ("“", "”"))) or text[-1] in "，、：（“‘—·")


_CODE = re.compile(r"^(`[FfEe][0-9IVXLCDM]{1,7}`\s*|[FfEe](?:\d{1,4}|[IVXLCDM]{1,7})[ \t]+)")


def goes_on(text: str) -> bool:
    bare = _CODE.sub("", text)
    return bool(re.match(r"[一-鿿A-Za-z]", bare)) and not is_note(text)


def joined(rows: list[dict]) -> list[dict]:
    """Rows (kind, text, ..) with cut paragraphs made whole.

    A paragraph goes on in a later one past notes and edge codes, or directly where it is
    surely cut; what was passed comes after it.
    """
    out: list[dict] = []
    at = 0
    while at < len(rows):
        first = rows[at]
        whole, passed, upto = first["text"], [], at + 1
        while first["kind"] == "p" and is_cut(whole):
            ahead = upto
            while ahead < len(rows) and rows[ahead]["kind"] in ("note", "edge"):
                ahead += 1
            more = rows[ahead] if ahead < len(rows) else None
            if not more or more["kind"] != "p" or not goes_on(more["text"]) or not (ahead > upto or is_surely_cut(whole)):
                break
            passed += rows[upto:ahead]
            whole += (" " if _CODE.match(more["text"]) else "") + more["text"]
            upto = ahead + 1
        out.append({**first, "text": re.sub(r"[  \n]", "", whole).strip()} if upto > at + 1 else first)
        out += passed
        at = upto
    return out
