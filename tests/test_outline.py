from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import numbering, text
from quire.operators import audit, books, outline, overlay, review


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("t", "level", "marker"),
    [
        ("第一部分 总论", 0, "part"), ("第十二章 某事", 0, "chapter"), ("第3节", 0, "sec"), ("一、开始", 0, "subsec"), ("（二）甲", 0, "subsubsec"), ("3. 乙", 0, "item"), ("（4）丙", 0, "subitem"),
        ("引言", 1, "opening"), ("结 语", 0, "closing"), ("附录 二", 0, "backmatter"), ("序", 0, "chapter"), ("目录", 1, "toc"), ("随便", 1, "chapter"), ("随便", 2, "plain"), ("随便", 0, None),
        ("12", 1, None), ("图 3 样", 1, None), ("ISBN 978", 1, None), ("", 1, None), ("一、", 0, None),
    ],
)
def test_classes(spark, t, level, marker):
    assert one(spark, numbering.classify("t", "lv"), t=t, lv=level) == marker


@pytest.mark.parametrize(("c", "kept"), [(c, False) for c in text.SPACE] + [("x", True), ("​", True)])
def test_whitespace_is_unicode(spark, c, kept):
    assert (one(spark, text.squeeze("t"), t=f"a{c}b") == f"a{c}b") is kept
    assert len(text.SPACE) == 29


@pytest.mark.parametrize(("t", "n"), [("１２", 12), (" ·7—", 7), ("12345", None), ("①", None), ("x1", None), ("", None), ("0", 0)])
def test_page_numbers(spark, t, n):
    assert one(spark, text.page_number("t"), t=t) == n


@pytest.mark.parametrize(("name", "clean"), [("书名 (z-lib.org)", "书名"), ("书名（作者）", "书名（作者）"), ("a [libgen] b", "a b")])
def test_site_tags(spark, name, clean):
    assert one(spark, text.strip_site_tags("t"), t=name) == clean


@pytest.mark.parametrize(("n", "s"), [(500, "500 B"), (2048, "2.0 KB"), (3 * 2**20, "3.0 MB")])
def test_human_sizes(spark, n, s):
    assert one(spark, text.human_size("n"), n=n) == s


def brute_parents(levels: list[int]) -> list[int | None]:
    return [next((j for j in range(i - 1, -1, -1) if levels[j] < levels[i]), None) for i in range(len(levels))]


def test_parents_against_brute_force(spark):
    import random

    rng = random.Random(5)
    cases = [[rng.randint(1, 9 if s % 2 else 40) for _ in range(rng.randint(1, 60))] for s in range(60)]
    rows = [(s, k, v) for s, levels in enumerate(cases) for k, v in enumerate(levels)]
    df = outline.with_parents(spark.createDataFrame(rows, "source_id long, seq long, level long"))
    got = {(r["source_id"], r["seq"]): r["parent"] for r in df.collect()}
    assert got == {(s, k): p for s, levels in enumerate(cases) for k, p in enumerate(brute_parents(levels))}


def test_roll_up_conserves_characters(spark):
    rows = [(1, k, 1 + k % 4, 10 + k) for k in range(30)]
    t = outline.with_parents(spark.createDataFrame(rows, "source_id long, seq long, level long, chars long")).withColumn("blocks", F.lit(1))
    total = {r["seq"]: r["total_chars"] for r in outline.rolled_up(t).collect()}
    tops = [r["seq"] for r in t.filter("parent is null").collect()]
    assert sum(total[s] for s in tops) == sum(10 + k for k in range(30))


def plain_ranks(rows):
    """The rules read one after the other, for the fold to agree with."""
    ranks, out, stack, back = numbering.RANK, [], [], False
    for k, (seq, marker, unnumbered, in_toc, trusted) in enumerate(rows):
        rest = [r[1] for r in rows[k + 1 :]]
        stops = {"plain": numbering.CHAPTER_RANKED}.get(marker, (*numbering.CHAPTER_RANKED, "opening", "closing"))
        ahead = next((m for m in rest if m in numbering.NUMBERED or m in stops), None)
        found = ranks[ahead] if ahead in numbering.NUMBERED else None
        if marker == "plain":
            rank = 20 + (trusted - 1) * 10 if trusted else found or (stack[-1][0] + 5 if stack else 20)
        elif marker in ("opening", "closing"):
            rank = found or next((r for r, _ in reversed(stack) if r <= 20), 20) + 20
        else:
            rank = ranks[marker]
        back |= marker == "backmatter"
        if back and marker == "chapter" and unnumbered and not in_toc:
            rank = 30
        while stack and stack[-1][0] >= rank:
            stack.pop()
        out.append((rank, stack[-1][1] if stack else None))
        if marker != "toc":
            stack.append((rank, seq))
    return out


MARKERS = ["part", "toc", "chapter", "backmatter", "sec", "subsec", "subsubsec", "item", "subitem", "plain", "opening", "closing"]


@given(st.lists(st.tuples(st.sampled_from(MARKERS), st.booleans(), st.booleans(), st.integers(0, 3)), max_size=25))
def test_rank_fold(rows):
    cases = [(k, *r) for k, r in enumerate(rows)]
    assert outline.fold_ranks(cases) == plain_ranks(cases)


@given(st.lists(st.tuples(st.sampled_from(MARKERS), st.booleans(), st.booleans(), st.integers(0, 3)), max_size=25))
def test_places_follow_the_folds_parents(rows):
    parents = [parent for _, parent in outline.fold_ranks([(k, *r) for k, r in enumerate(rows)])]
    got = list(outline.fold_places(list(enumerate(parents))))
    assert [r["parent"] for r in got] == parents and len({r["nid"] for r in got}) == len(rows)
    for k, r in enumerate(got):
        up, at = [], parents[k]
        while at is not None:
            up, at = [at, *up], parents[at]
        assert r["ancestors"] == up and r["depth"] == len(up) + 1
        assert r["nid"] == ".".join(str(got[j]["ordinal"]) for j in [*up, k]) and r["ordinal"] == parents[: k + 1].count(parents[k])


def test_books_nest_without_bound(spark):
    titles = ["第一章 总论"] + [f"随便标题{chr(0x4E00 + k)}" for k in range(40)]
    rows = [(1, k, 1, k, "text", t, 1 if k == 0 else 2) for k, t in enumerate(titles)]
    blocks = spark.createDataFrame(rows, "source_id long, gid long, shard_ord long, page_idx long, type string, text string, text_level int")
    tree = sorted(books.recompute(blocks).tree.select("seq", "marker", "parent", "depth", "nid").collect())
    assert [r["marker"] for r in tree] == ["chapter"] + ["plain"] * 40
    assert [(r["parent"], r["depth"], r["nid"]) for r in tree] == [(k or None, k + 1, ".".join(["1"] * (k + 1))) for k in range(41)]  # places count from 1


def test_greedy_matches_take_an_entry_once():
    nodes, entries = [(1, "abcd"), (2, "abcde"), (3, "xy")], [(7, "abcde"), (8, "abcd"), (9, "xy")]
    assert outline.greedy_matches(nodes, entries, True) == [(1, 7), (2, 8), (3, 9)]
    assert outline.greedy_matches(nodes, entries, False) == [(1, 7), (2, 8)]


def test_misread_entries_follow_the_last_accepted(spark):
    rows = [(1, k, p) for k, p in enumerate([10, 20, 18, 12, 19, 200, 21, 197])]
    got = outline.misread_entries(spark.createDataFrame(rows, "source_id long, ord long, printed long"))
    assert sorted(r["ord"] for r in got.collect()) == [3, 6]


def test_printed_contents_of_three_shapes(spark):
    lines = ["目录", "第一部分 总论", "见证与发现……冯某某 001", "技术与政策的外部条件", "……刘某 李某 003", "发展的报告", "邱某某 王 某 244", "没有页码"]
    got = outline.printed_toc(spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "source_id long, ord long, line string")).orderBy("ord").collect()
    assert [(r["kind"], r["title"], r["printed"]) for r in got] == [("part", "第一部分 总论", None), ("chapter", "见证与发现", 1), ("chapter", "技术与政策的外部条件", 3), ("chapter", "发展的报告", 244)]


def test_contents_region_by_heading_and_by_lines(spark):
    page = lambda s, gid, p, t: (s, gid, 1, p, "text", t)
    dots = "一…………1\n二…………2\n三…………3"
    rows = [page(1, 0, 0, "x"), page(1, 1, 2, "目录"), page(1, 2, 3, dots), page(1, 3, 4, dots), page(1, 4, 6, dots), page(2, 0, 5, dots), page(3, 0, 0, "y")]
    got = outline.toc_regions(spark.createDataFrame(rows, "source_id long, gid long, shard_ord long, page_idx long, type string, text string"))
    assert {(r["source_id"], r["heading_page"], r["last_page"]) for r in got.collect()} == {(1, 2, 4), (2, 5, 5)}


def tree(spark, rows):
    return outline.with_parents(spark.createDataFrame([(1, k, lv, t) for k, (lv, t) in enumerate(rows)], "source_id long, seq long, level long, title string"))


@pytest.mark.parametrize(
    ("rows", "check"),
    [
        ([(1, "a"), (3, "b")], "level_jump"),
        ([(1, "a"), (2, "四、小结"), (2, "四、小结")], "duplicate_title"),
    ],
)
def test_structure_findings(spark, rows, check):
    t = tree(spark, rows)
    found = audit.level_jumps(t).unionByName(audit.duplicate_titles(t))
    assert [r["check"] for r in found.collect()] == [check]


def test_numbering_findings(spark):
    t = tree(spark, [(1, "一、甲"), (1, "三、乙"), (1, "三、丙"), (1, "二、丁"), (1, "1. 甲"), (1, "3. 乙")])
    got = sorted((r["check"], r["severity"]) for r in audit.numbering_breaks(t).collect())
    assert got == [("numbering_gap", "high"), ("numbering_gap", "warn"), ("numbering_repeat", "high"), ("numbering_restart", "warn")]
    assert [r["expect"] for r in audit.gap_probes(t).orderBy("after_seq").collect()] == ["二、", "2. "]


def test_deleting_an_addition_takes_it_back(spark):
    deleted = spark.createDataFrame([(1, "5")], "source_id long, key string")
    added = spark.createDataFrame([(1, 7, "t", 2)], "source_id long, gid long, title string, level long")
    levels = spark.createDataFrame([(1, "add:7", 3)], "source_id long, key string, level long")
    d, a, lv = overlay.set_deleted(deleted, added, levels, spark.createDataFrame([(1, "add:7"), (1, "9")], "source_id long, key string"))
    assert {r["key"] for r in d.collect()} == {"5", "9"} and a.count() == 0 and lv.count() == 0


def test_page_support_has_both_signs(spark):
    seen = spark.createDataFrame([(1, 1, 4, 14), (1, 1, 6, 16)], "source_id long, shard_ord long, page_idx long, printed long")
    asked = spark.createDataFrame([(1, 1, 5, 15), (1, 1, 4, 14), (1, 1, 7, 17), (1, 1, 3, 13), (1, 1, 5, 99)], "source_id long, shard_ord long, page_idx long, printed long")
    assert {(r["page_idx"], r["printed"]): r["support"] for r in review.page_support(asked, seen).collect()} == {(5, 15): "both", (4, 14): "page", (7, 17): "previous", (3, 13): "next", (5, 99): "none"}


def test_patterns_are_matched_once_a_row(spark):
    """Filters and later columns don't repeat what a column of patterns costs."""
    lines = spark.createDataFrame([(1, 0, "第一章 某某……12")], "source_id long, ord long, line string")
    entries = outline.printed_toc(lines)
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    assert sum(plan.count(f) for f in ("regexp_replace(", "RLIKE")) <= 12
    tree = spark.createDataFrame([(1, 1, None, "第一章", 1)], "source_id long, seq long, parent long, title string, depth long")
    plan = audit.numbering_breaks(tree)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 12 and "Join" not in plan
