"""The whole chain for books against the rules read one after the other, source by source."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest

from quire.functions import numbering as num
from quire.functions import text
from quire.operators import books, calibration, outline
from quire.plans import workflow
from tests.test_outline import plain_ranks


def has(pattern: str, s: str) -> bool:
    return re.search(pattern.replace(r"\z", r"\Z").replace(r"(?s)", ""), s) is not None


def strip(s: str) -> str:
    return s.strip(text.SPACE)


def clean(s: str) -> str:
    s = re.sub(r"\\+([*_`#\[\]()~])", r"\1", strip(s))
    return strip(strip(s).lstrip("#*" + text.SPACE).rstrip("*" + text.SPACE))


def key_of(s: str) -> str:
    return re.sub(rf"[{text.SPACE}·・:：,，.。;；\-—–_()（）\[\]【】\"'“”‘’!！?？]+", "", strip(s)).lower()


def loose(s: str) -> str:
    return re.sub(rf"[{text.SPACE}·．.…\-—_、，,：:（）()*]+", "", s)


NUMBERED = (num.PART, num.CHAPTER, num.SECTION, num.SUBSECTION, num.SUBSUBSECTION, num.ITEM, num.SUBITEM)
CLASSES = ((num.PART, "part"), (num.CHAPTER, "chapter"), (num.FRONT, "chapter"), (num.BACK, "backmatter"), (num.OPENING, "opening"), (num.CLOSING, "closing"), (num.SECTION, "sec"), (num.SUBSECTION, "subsec"), (num.SUBSUBSECTION, "subsubsec"), (num.SUBITEM, "subitem"), (num.ITEM, "item"))


def marker(t: str, level: int | None, running: bool) -> str | None:
    if not t or has("(?i)" + text.NOISE_TEXT.removeprefix("(?i)"), t) or any(has(p, t) for p in text.NOISE_TITLE):
        return None
    if t in text.TOC_WORDS:
        return "toc"
    if running:
        return None
    return next((name for p, name in CLASSES if has(p, t)), {1: "chapter", 2: "plain"}.get(level or 0))


def running_keys(rows: list) -> set:
    pages, every = defaultdict(set), {(r["shard_ord"], r["page_idx"]) for r in rows}
    for r in rows:
        t = strip(r["text"])
        k = re.sub(f"{text.W}+", " ", re.sub(rf"^[{text.SPACE}0-9.·\-—]{{0,6}}", "", t)).strip(" .·-—")
        structural = any(has(p, t) for p in (num.PART, num.CHAPTER, num.SECTION, num.SUBSECTION, num.SUBSUBSECTION, num.ITEM, num.OPENING, num.CLOSING, num.FRONT, num.BACK)) or t in text.TOC_WORDS
        if t and len(t) <= 60 and "\n" not in t and not structural and len(k) >= 4:
            pages[k].add((r["shard_ord"], r["page_idx"]))
    return {k for k, p in pages.items() if len(p) >= max(5, int(len(every) * 0.08))}, lambda t: re.sub(f"{text.W}+", " ", re.sub(rf"^[{text.SPACE}0-9.·\-—]{{0,6}}", "", t)).strip(" .·-—")


def contents(rows: list) -> tuple[tuple | None, list]:
    """(region, entries (title, printed)) of the one-line shapes that the blocks have."""
    count, first = defaultdict(int), {}
    for r in rows:
        if r["type"] == "text":
            page = (r["shard_ord"], r["page_idx"])
            count[page] += sum(has(outline.TOC_LINE, strip(x)) or has(outline.TOC_NUMBERED, strip(x)) for x in r["text"].split("\n"))
            first.setdefault(page, r["gid"])
    head = next(((r["shard_ord"], r["page_idx"]) for r in rows if r["type"] == "text" and strip(r["text"]) in text.TOC_WORDS), None)
    busy = [p for p in count if count[p] >= 3]
    start = head or (max(busy, key=lambda p: (count[p], -first[p])) if busy else None)
    if start is None:
        return None, []
    last = start[1]
    while count.get((start[0], last + 1), 0) >= 3 and last + 1 < start[1] + 12:
        last += 1
    entries = []
    for r in rows:
        if r["type"] == "text" and r["shard_ord"] == start[0] and start[1] <= r["page_idx"] <= last:
            for x in map(strip, r["text"].split("\n")):
                m = re.search(r"[.．·…]{2,}", x)
                page = re.search(r"([0-9]{1,4})\Z", x)
                if m and page and len(strip(x[: m.start()])) > 4:
                    entries.append((clean(strip(x[: m.start()])), int(page[1])))
    return (start[0], start[1], last), entries


def candidates(rows: list) -> tuple[list, list]:
    region, entries = contents(rows)
    running, run_key = running_keys(rows)
    figures = {(r["shard_ord"], r["page_idx"]) for r in rows if r["type"] == "text" and has(text.FIGURE_CAPTION, strip(r["text"]))}
    out = []
    for r in rows:
        t = strip(r["text"])
        if r["type"] != "text" or not (r["text_level"] or any(has(p, t) for p in (num.PART, num.CHAPTER, num.SECTION))):
            continue
        same = region is not None and r["shard_ord"] == region[0]
        if same and r["page_idx"] <= region[2]:
            continue
        if (r["shard_ord"], r["page_idx"]) in figures and not any(has(p, t) for p in NUMBERED) and len(t) < 30:
            continue
        if not t or len(t) > 60 or t[-1] in text.SENTENCE_END or "\n" in t:
            continue
        m = marker(t, r["text_level"], run_key(t) in running)
        if m:
            out.append({"gid": r["gid"], "borrowed": 0, "key": str(r["gid"]), "text": r["text"], "marker": m, "shard_ord": r["shard_ord"], "page_idx": r["page_idx"]})
    return out, entries


def repaired(found: list, entries: list, rows: list, segs: list) -> list:
    known = [loose(clean(c["text"])) for c in found]
    firsts = {}
    for r in rows:
        firsts.setdefault((r["shard_ord"], r["page_idx"]), r)
    out = []
    for title, printed in entries:
        k = loose(title)
        hit = lambda e, k=k: e and (k == e if len(k) < 4 else (len(e) >= 4 and (k in e or e in k)) or (len(e) >= 2 and k.startswith(e)))
        if not printed or not k or any(hit(e) for e in known):
            continue
        on = [s for s in segs if s["printed_start"] <= printed <= s["printed_end"]]
        if not on:
            continue
        s = min(on, key=lambda s: (s["kind"] != "body", -s["n_obs"], s["shard_ord"], s["page_start"], s["seg_ord"]))
        page = printed - s["offset"]
        block = next((firsts[s["shard_ord"], p] for p in range(page, page + 4) if (s["shard_ord"], p) in firsts), None)
        if block is None:
            continue
        known.append(k)
        out.append({"gid": block["gid"], "borrowed": 1, "key": f"toc:P{s['shard_ord']}:{block['gid']}:{key_of(title)}", "text": title, "marker": "chapter", "shard_ord": s["shard_ord"], "page_idx": block["page_idx"]})
    return out


def automatic(rows: list, segs: list, added: list) -> list:
    found, entries = candidates(rows)
    every = found + repaired(found, entries, rows, segs)
    at = {r["gid"]: r for r in rows}
    every += [{"gid": g, "borrowed": 2, "key": f"add:{g}", "text": t, "marker": "chapter", "shard_ord": at[g]["shard_ord"], "page_idx": at[g]["page_idx"]} for g, t, _ in added if g in at]
    every.sort(key=lambda c: (c["gid"], c["borrowed"] > 0, c["borrowed"]))
    seen = set()
    for k, c in enumerate(every):
        if c["key"] in seen:
            c["key"] = f"{c['key']}#{k}"
        seen.add(c["key"])
    listed = {key_of(t) for t, _ in entries}
    ranked = plain_ranks([(k, c["marker"], not any(has(p, strip(c["text"])) for p in NUMBERED), key_of(clean(c["text"])) in listed, 0) for k, c in enumerate(every)])
    depth = []
    for _, parent in ranked:
        depth.append(1 if parent is None else depth[parent] + 1)
    nodes = [{"key": c["key"], "marker": c["marker"], "title": clean(c["text"]), "gid": c["gid"], "level": d} for c, d in zip(every, depth, strict=True)]
    if not nodes or nodes[0]["gid"] > rows[0]["gid"]:
        nodes.insert(0, {"key": str(rows[0]["gid"]), "marker": "front", "title": books.FRONT_TITLE, "gid": rows[0]["gid"], "level": 1})
    return nodes


def corrected(rows: list, segs: list, levels: dict, deleted: set, added: list) -> list:
    nodes, base = automatic(rows, segs, added), {n["key"]: n["level"] for n in automatic(rows, segs, [])}
    given = {f"add:{g}": lv for g, _, lv in added if g in {r["gid"] for r in rows}} | levels
    nodes = [n | {"level": given.get(n["key"], base.get(n["key"], n["level"]))} for n in nodes if n["marker"] == "front" or n["key"] not in deleted]
    open_, count, out = [], defaultdict(int), []
    for n in nodes:
        while open_ and open_[-1][0] >= n["level"]:
            open_.pop()
        above = open_[-1][1] if open_ else ""
        count[above] += 1
        nid = f"{above}.{count[above]}" if above else str(count[above])
        out.append((n["key"], nid, n["level"], nid.count(".") + 1, n["marker"], n["title"]))
        open_.append((n["level"], nid))
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_the_whole_chain(spark, sf):
    blocks, overlay = workflow._book_blocks(spark, sf).cache(), workflow._book_overlay(spark, sf)
    by = lambda df: {k: [r for r in rows if r["source_id"] == k] for rows in [df.collect()] for k in {r["source_id"] for r in rows}}
    rows, segs = by(blocks), by(calibration.calibrated(calibration.observations(blocks)))
    levels, deleted, added = by(overlay.levels), by(overlay.deleted), by(overlay.added)
    book = books.recompute(blocks, overlay=overlay)
    got = by(book.tree)
    assert set(got) == set(rows)
    used = set()
    for source, own in rows.items():
        own.sort(key=lambda r: r["gid"])
        want = corrected(own, segs.get(source, []), {r["key"]: r["level"] for r in levels.get(source, [])}, {r["key"] for r in deleted.get(source, [])}, [(r["gid"], r["title"], r["level"]) for r in added.get(source, [])])
        made = sorted(got[source], key=lambda r: r["seq"])
        assert [(r["key"], r["nid"], r["level"], r["depth"], r["marker"], r["title"]) for r in made] == want, source
        used |= {w[0].split(":")[0] for w in want if ":" in w[0]} | {w[4] for w in want}
        marks = [(r["gid"], r["key"]) for r in made]
        for b in (r for r in by_source(book.owned, source) if source < 20):
            assert b["key"] == next((k for g, k in reversed(marks) if g <= b["gid"]), None)
    assert {"toc", "add", "front", "chapter"} <= used


def by_source(df, source: int) -> list:
    return df.filter(f"source_id = {source}").collect() if source < 20 else []


def test_a_repair_counts_as_a_title(spark):
    entries = spark.createDataFrame([(1, 0, "chapter", "没有的一章", 3, True, 5), (1, 1, "chapter", "没有的一章续", 4, True, 6), (1, 2, "chapter", "另外的", 9, False, None), (1, 3, "chapter", "第二章 已有", 7, True, 8)], "source_id long, ord long, kind string, title string, printed long, page_known boolean, gid long")
    titles = spark.createDataFrame([(1, "第二章")], "source_id long, title string")
    assert {(r["ord"], r["status"]) for r in outline.repaired_entries(entries, titles).collect()} == {(0, "added"), (2, "no page")}
