"""Reports in Markdown: calibration, outline, audit, verification; a text for each source.

Lines are rows with a place, joined in order at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.calibration import all_rows

MOST_DROPPED, MOST_LISTED = 80, 12
MARKS = {"pass": "✅", "warn": "⚠️", "fail": "❌", "skip": "➖"}
SEVERITIES = (("high", "🔴 必须处理"), ("warn", "🟡 建议核对"), ("info", "⚪ 现状记录"))


def line(rows: DataFrame, part: int, order: Column | None, *pieces: Column | str) -> DataFrame:
    """(source_id, part, ord, line) of pieces put together."""
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces])
    return rows.select("source_id", F.lit(part).alias("part"), (order if order is not None else F.lit("")).cast("string").alias("ord"), text.alias("line"))


def place(*columns: str) -> Column:
    """A string that sorts as whole numbers do."""
    return F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 12, "0") for c in columns])


def told(*lines: DataFrame) -> DataFrame:
    """(source_id, report)."""
    listed = F.array_sort(F.collect_list(F.struct("part", "ord", "line")))
    return all_rows(*lines).groupBy("source_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("report"))


def head(rows: DataFrame, part: int, *texts: str) -> list[DataFrame]:
    """The same lines for every source of rows, as one row."""
    return [line(rows.select("source_id").distinct(), part, None, "\n".join(texts))]


def signed(c: str) -> Column:
    return F.concat(F.when(F.col(c) >= 0, "+").otherwise(""), F.col(c).cast("string"))


def calibration_report(verdicts: DataFrame, segs: DataFrame, gaps: DataFrame, checks: DataFrame, conflicts: DataFrame) -> DataFrame:
    """What was calibrated: verdict, table of segments, gaps, how shards go on, headers that disagree."""
    c = F.col
    table = ("| 分片 | 类型 | 物理页 range | 纸书页 range | offset | 观测 | 覆盖 | 置信 |", "| --- | --- | --- | --- | --- | --- | --- | --- |")
    share = F.concat(F.bround(c("coverage") * 100, 0).cast("int"), F.lit("%"))
    return told(
        *head(verdicts, 0, "# 页码校准报告", ""), line(verdicts, 1, None, "- 判定：**", c("verdict"), "** ／ locator_type = `", c("locator_type"), "`"), *head(verdicts, 2, "", "## 区间表", "", *table),
        line(segs, 3, place("shard_ord", "page_start"), "| P", c("shard_ord"), " | ", c("kind"), " | ", c("page_start"), "–", c("page_end"), " | ", c("printed_start"), "–", c("printed_end"), " | ", signed("offset"), " | ", c("n_obs"), " | ", share, " | ", c("confidence"), " |"),
        *head(gaps, 4, "", "## 断点（不填、不外推）", ""), line(gaps, 5, place("shard_ord", "after_page"), "- P", c("shard_ord"), " 物理页 ", c("after_page"), "→", c("before_page"), " 之间漏 ", c("n_unmapped"), " 页"),
        *head(checks, 6, "", "## 跨分片接续", "", "| 从 | 到 | 期望 | 实际 | 结论 |", "| --- | --- | --- | --- | --- |"),
        line(checks, 7, place("shard_ord", "page_start"), "| P", c("prev_shard"), " | P", c("shard_ord"), " | ", c("expected"), " | ", c("next_printed"), " | ", F.when(c("ok"), "✅").otherwise("⚠️"), " ", c("note"), " |"),
        *head(conflicts, 8, "", "## 页眉与页码冲突（已以 page_number 为准）", ""), line(conflicts, 9, place("shard_ord", "page_idx"), "- P", c("shard_ord"), " 物理页 ", c("page_idx"), "：page_number=", c("page_number"), "，header=", c("header")),
    )


def outline_report(nodes: DataFrame, stats: DataFrame, dropped: DataFrame) -> DataFrame:
    """What a tree is like: its levels, its nodes(source_id, seq, nid, depth, title, marker, shard_ord, page_idx, chars, blocks), and what was dropped.

    Each table is read once; what stands around its lines comes when a source's lines are together.
    """
    c = F.col
    w = Window.partitionBy("source_id")
    gone = dropped.withColumns({"k": F.row_number().over(w.orderBy("gid")), "n": F.count("*").over(w)}).filter(c("k") <= MOST_DROPPED)
    table = ("| 层级 | 节点数 | 若切到本层=文件数 | 总字数 | 平均字数 | 最小 | 最大 | 空节点 |", "| --- | --- | --- | --- | --- | --- | --- | --- |")
    over = F.when(c("k") == 1, "\n".join(["", "## 被丢弃的候选标题", "", "| 分片 | 物理页 | 文本 | 原因 |", "| --- | --- | --- | --- |"]))
    under = F.when(c("k") == F.least(c("n"), F.lit(MOST_DROPPED)), F.concat(F.lit("\n（共 "), c("n"), F.lit(" 条）")))
    item = F.concat(F.lit("| P"), c("shard_ord"), F.lit(" | "), c("page_idx"), F.lit(" | "), F.substring("text", 1, 50), F.lit(" | "), c("drop_reason"), F.lit(" |"))
    shown = F.when(over.isNotNull() | item.isNotNull() | under.isNotNull(), F.concat_ws("\n", over, item, under))
    lines = all_rows(
        line(stats, 3, place("level"), "| L", c("level"), " | ", c("nodes"), " | **", c("files_if_split"), "** | ", c("chars"), " | ", c("avg_chars"), " | ", c("min_chars"), " | ", c("max_chars"), " | ", c("empty"), " |"),
        line(nodes, 5, place("seq"), F.repeat(F.lit("    "), (c("depth") - 1).cast("int")), "- `", c("nid"), "` **", c("title"), "** 〔", c("marker"), "｜P", c("shard_ord"), "p", c("page_idx"), "｜", c("chars"), "字｜", c("blocks"), "块〕"),
        line(gone, 7, place("k"), shown),
    )
    own = lines.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("part", "ord", "line"))).alias("x"), F.count_if(c("part") == 5).alias("n"))
    told_of = lambda *parts: F.transform(F.filter("x", lambda x: x["part"].isin(*parts)), lambda x: x["line"])
    opening = F.concat(F.lit("# 目录索引："), c("source_id"), F.lit("\n- 节点总数："), c("n"), F.lit("\n".join(["", "", "## 层级统计（选切分深度用）", "", *table])))
    whole = F.concat(F.array(opening), told_of(3), F.array(F.lit("\n## 目录树\n")), told_of(5, 7))
    return own.select("source_id", F.array_join(F.when(c("n") > 0, whole).otherwise(told_of(3, 5, 7)), "\n").alias("report"))


def audit_report(summary: DataFrame, findings: DataFrame) -> DataFrame:
    """What an audit found: summary(source_id, high, warn, info, verdict), and findings(source_id, id, check, severity, detail, place) by severity."""
    c = F.col
    own = [line(summary, 0, None, "# 目录校核：", c("source_id")), line(summary, 1, None, "- 判定：**", c("verdict"), "** ｜ 🔴 ", c("high"), " 🟡 ", c("warn"), " ⚪ ", c("info"))]
    for k, (severity, title) in enumerate(SEVERITIES):
        rows = findings.filter(c("severity") == severity)
        own += [line(summary, 10 * k + 2, None, f"\n## {title}（", c(severity), "）"), line(summary.filter(c(severity) == 0), 10 * k + 3, None, "- ✅ 无")]
        detail = F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit("\n    - "), c("detail"))).otherwise("")
        own.append(line(rows, 10 * k + 4, place("place"), "- **", c("id"), "** `", c("check"), "`", detail))
    return told(*own)


def verify_report(verdicts: DataFrame, gates: DataFrame) -> DataFrame:
    """What the gates said: verdicts(source_id, verdict), gates(source_id, gate, name, status, note)."""
    c = F.col
    mark = lambda s: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), s), F.lit(""))
    return told(
        line(verdicts, 0, None, "# 校验报告：", c("source_id")), line(verdicts, 1, None, "- 总判定：**", mark(c("verdict")), " ", c("verdict"), "**"), *head(verdicts, 2, "", "| 闸门 | 名称 | 结果 | 说明 |", "| --- | --- | --- | --- |"),
        line(gates, 3, c("gate"), "| ", c("gate"), " | ", c("name"), " | ", mark(c("status")), " ", c("status"), " | ", F.coalesce("note", F.lit("")), " |"),
    )
