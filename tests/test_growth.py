"""Steps that must not be taken again for each use of their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text
from quire.functions.text import SPACE, W
from quire.operators import export, outline
from quire.plans import registry
from tests.compare import told


def python_passes(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def same_rows(a, b) -> bool:
    return told([r.asDict() for r in a.collect()]) == told([r.asDict() for r in b.collect()])


def test_titles_pass_with_the_tree(spark, sf):
    for name in ("f18_file_names", "j22_breadcrumbs", "k04_index_rows"):
        assert python_passes(registry.QUERIES[name](spark, sf)) == 1
    rows = [(s, k, lv, None if k == 3 else f"t{s}.{k} › x") for s in (1, 2) for k, lv in enumerate([1, 2, None, 2, 3, 1, 4, 4])]
    nodes = spark.createDataFrame(rows, "source_id long, seq long, level int, title string")
    assert same_rows(outline.breadcrumbs(outline.with_parents(nodes, title="title")), outline.breadcrumbs(outline.with_parents(nodes)))


def test_safe_names_are_what_they_were(spark):
    odd = ["", " ", ".", "a", "a b", "a  b", " a", "a ", "a.", ".a", "a/b", "a\\b:c*d?e\"f<g>h|i", "a\tb", "a　b", "a ", "a\x00b", "x" * 79 + " y", "x" * 100, "第三章", "a.b", "a\n", "..", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k long, t string")
    t = F.regexp_replace(F.regexp_replace("t", r'[\\/:*?"<>|\x00-\x1f]+', "_"), f"{W}+", " ")
    t = F.substring(F.regexp_replace(t, r"^[ .]+|[ .]+\z", ""), 1, 80)
    before = F.when(t == "", "untitled").otherwise(F.regexp_replace(t, r"[ .]+\z", ""))
    assert not df.filter(~text.safe_filename("t").eqNullSafe(before)).collect()
    assert set(SPACE) - {" "} <= set(text.UNSAFE_NAME)


def test_long_chains_lose_their_outermost(spark):
    df = spark.createDataFrame([(7, ["a" * 60, "b" * 60, "c"], "d"), (8, [], "e" * 120), (9, ["p"], "q")], "seq long, crumbs array<string>, title string")
    got = [r[0] for r in df.orderBy("seq").select(export.file_name("seq", "crumbs", "title")).collect()]
    assert got == ["007_" + "b" * 60 + "_c_d.md", "008_" + "e" * 100 + ".md", "009_p_q.md"]


def test_outline_report_reads_each_table_once(spark, sf):
    df = registry.QUERIES["k08_outline_reports"](spark, sf)
    assert python_passes(df) == 1


def test_outline_report_keeps_lines_around_null_texts(spark):
    from quire.operators import reports

    dropped = spark.createDataFrame([(1, g, 1, g, None if g in (0, 2) else f"x{g}", "noise") for g in range(3)], "source_id long, gid long, shard_ord int, page_idx long, text string, drop_reason string")
    nodes = spark.createDataFrame([(1, 1, "1", 1, "T", "chapter", 1, 3, 9, 1)], "source_id long, seq long, nid string, depth long, title string, marker string, shard_ord int, page_idx long, chars long, blocks long")
    stats = outline.level_stats(nodes.withColumn("level", F.lit(1)))
    (got,) = [r["report"] for r in reports.outline_report(nodes, stats, dropped).collect()]
    assert got.split("\n") == [
        "# 目录索引：1", "- 节点总数：1", "", "## 层级统计（选切分深度用）", "", "| 层级 | 节点数 | 若切到本层=文件数 | 总字数 | 平均字数 | 最小 | 最大 | 空节点 |", "| --- | --- | --- | --- | --- | --- | --- | --- |", "| L1 | 1 | **1** | 9 | 9 | 9 | 9 | 0 |",
        "", "## 目录树", "", "- `1` **T** 〔chapter｜P1p3｜9字｜1块〕", "", "## 被丢弃的候选标题", "", "| 分片 | 物理页 | 文本 | 原因 |", "| --- | --- | --- | --- |", "| P1 | 1 | x1 | noise |", "", "（共 3 条）",
    ]


def test_verify_report_computes_gates_once(spark, sf):
    plan = registry.QUERIES["k08_verify_reports"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
