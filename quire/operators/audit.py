"""Rules that find what is wrong with an outline; every finding is a row.

Findings have source_id, check, severity, seq of the node they are about and detail. A
rule of high severity below the focus depth only warns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import numbering, text

FOCUS_DEPTH = 3


def finding(rows: DataFrame, check: Column | str, severity: Column | str, detail: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    level = F.when((level == "high") & (F.col("depth") > FOCUS_DEPTH), "warn").otherwise(level)
    return rows.select("source_id", (F.lit(check) if isinstance(check, str) else check).alias("check"), level.alias("severity"), "seq", detail.alias("detail"))


def level_jumps(tree: DataFrame) -> DataFrame:
    """C01: a node more than one level below its parent."""
    rows = with_parent(tree, "level").filter("level - parent_level > 1")
    return finding(rows, "level_jump", "warn", F.concat_ws(" ", "parent_level", "level"))


def with_parent(tree: DataFrame, *columns: str) -> DataFrame:
    """Nodes that have a parent, with columns of it.

    The parent is the last node of a smaller level, so its values come by window.
    """
    own = tree.select("source_id", F.col("seq").alias("parent"), *[F.col(c).alias(f"parent_{c}") for c in columns])
    return tree.filter("parent is not null").join(own, ["source_id", "parent"])


def duplicate_titles(tree: DataFrame) -> DataFrame:
    """C02: a title that an earlier sibling has."""
    w = Window.partitionBy("source_id", "parent", "k").orderBy("seq")
    rows = text.once(tree, k=text.audit_key("title")).filter("k <> ''").withColumn("first", F.first("seq").over(w)).filter("seq <> first")
    return finding(rows, "duplicate_title", "high", F.col("first").cast("string"))


def numbered_siblings(tree: DataFrame) -> DataFrame:
    """Nodes with a number, and that of the sibling before them in the same tier."""
    w = Window.partitionBy("source_id", "parent", "tier").orderBy("seq")
    rows = text.once(tree, t=text.strip("title"))
    rows = text.once(rows, x=numbering.tier("t")).withColumns({"tier": F.col("x.tier"), "n": F.col("x.n")}).filter("n is not null")
    return rows.drop("x", "t").withColumns({"prev_n": F.lag("n").over(w), "prev_seq": F.lag("seq").over(w)})


def numbering_breaks(tree: DataFrame) -> DataFrame:
    """C03 repeats, C04 gaps and C05 restarts among numbered siblings."""
    rows = numbered_siblings(tree).filter("prev_n is not null and n <> prev_n + 1")
    check = F.when(F.col("n") == F.col("prev_n"), "numbering_repeat").when(F.col("n") > F.col("prev_n"), "numbering_gap").otherwise("numbering_restart")
    severity = F.when(F.col("n") == F.col("prev_n"), "high").when((F.col("n") > F.col("prev_n")) & (F.col("tier") != "arabic"), "high").otherwise("warn")
    return finding(rows, check, severity, F.concat_ws(" ", "tier", "prev_n", "n"))


def gap_probes(tree: DataFrame) -> DataFrame:
    """What to search for in a gap: the missing numbers as printed, between two nodes."""
    rows = numbered_siblings(tree).filter("n > prev_n + 1")
    expect = F.transform(F.sequence(F.col("prev_n") + 1, F.col("n") - 1), lambda k: numbering.printed_number("tier", k))
    return rows.select("source_id", F.col("prev_seq").alias("after_seq"), F.col("seq").alias("before_seq"), F.array_join(expect, "|").alias("expect"))


def page_steps(tree: DataFrame) -> DataFrame:
    """Siblings with page numbers (zone, page) and the last one before them that has one."""
    w = Window.partitionBy("source_id", "parent").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return tree.filter("page is not null").withColumn("prev", F.last(F.struct("zone", "page", "seq"), True).over(w)).filter("prev is not null")


def page_findings(tree: DataFrame) -> DataFrame:
    """C06 to C09: pages that cross zones, go back, or come before their parent; top nodes in front matter."""
    steps = page_steps(tree)
    cross = finding(steps.filter("zone <> prev.zone"), "page_zone_crossing", "warn", F.col("prev.seq").cast("string"))
    back = finding(steps.filter("zone = prev.zone and page < prev.page"), "page_decreasing", "high", (F.col("page") - F.col("prev.page")).cast("string"))
    below = with_parent(tree, "zone", "page").filter("parent_zone = zone and page < parent_page")
    early = finding(below, "page_parent_after_child", "warn", F.concat_ws(" ", "parent_page", "page"))
    top = finding(tree.filter("level <= 2 and zone = 1"), "top_node_in_front_zone", "info", F.col("page").cast("string"))
    return reduce(DataFrame.unionByName, (cross, back, early, top))


def without_outliers(tree: DataFrame, outliers: DataFrame) -> DataFrame:
    """Nodes off pages whose number was misread; their symptoms are the misreading's."""
    return tree.join(outliers.select("source_id", "shard_ord", "page_idx").distinct(), ["source_id", "shard_ord", "page_idx"], "left_anti")


def contents_deltas(matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C12 and C13 over matched(source_id, seq, depth, page, printed, suspect): page mismatches, and a shift that most share."""
    rows = matched.withColumn("delta", F.col("page") - F.col("printed")).filter("delta <> 0")
    size = F.abs("delta")
    severity = F.when(F.col("suspect"), "warn").when(size <= 2, "info").when(size <= 20, "warn").otherwise("high")
    mismatch = finding(rows, "toc_page_mismatch", severity, F.col("delta").cast("string"))
    by = rows.groupBy("source_id", "delta").agg(F.count("*").alias("n"), F.min("seq").alias("since"))
    shift = by.filter("n >= 3").groupBy("source_id").agg(F.max_by(F.struct("delta", "n"), F.struct("n", -F.col("since"))).alias("m"))
    return mismatch, shift.select("source_id", F.col("m.delta").alias("delta"), F.col("m.n").alias("entries"))


def unmatched_entries(entries: DataFrame, matched: DataFrame) -> DataFrame:
    """C14 and C15: contents entries(source_id, ord, title, printed) that no node matches."""
    left = entries.join(matched.select("source_id", "ord").distinct(), ["source_id", "ord"], "left_anti")
    left = text.once(left, t=text.strip("title"))
    tagged = numbering.tier("t").isNotNull() | F.col("t").rlike(rf"^第{text.W}*[{numbering.NUMERALS}零0-9]{{1,3}}{text.W}*[部分篇编]")
    left = text.once(left, tagged=tagged)
    whole = F.col("printed").isNotNull() & (F.col("printed") != 0) & F.col("tagged")
    return left.select("source_id", "ord", F.when(whole, "toc_entry_undetected").otherwise("toc_entry_fragment").alias("check"), F.when(whole, "high").otherwise("warn").alias("severity"))


def dropped_findings(dropped: DataFrame, entries: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """C16 to C19 over dropped candidates(source_id, gid, text, drop_reason): what a contents list backs, what has a number, what only echoes, what is too long."""
    rows = dropped if added is None else dropped.join(added.select("source_id", "gid"), ["source_id", "gid"], "left_anti")
    rows = text.once(rows, k=text.audit_key("text"), head=text.strip(F.substring_index("text", "\n", 1)))
    e = text.once(entries, e=text.audit_key("title")).select("source_id", "ord", "e").filter("length(e) >= 4")
    hit = rows.filter("length(k) >= 4").join(e, "source_id").filter(F.col("e").contains(F.col("k")) | F.col("k").contains(F.col("e")))
    backed = hit.groupBy("source_id", "gid").agg(F.min("ord").alias("backed_by"))
    rows = rows.join(backed, ["source_id", "gid"], "left")
    rows = text.once(rows, numbered=numbering.tier("head").isNotNull())
    short = F.length("text") <= 60
    check = (
        F.when(F.col("backed_by").isNotNull() & short & (F.col("drop_reason") != "contents page"), "dropped_toc_backed")
        .when(F.col("numbered") & short, "dropped_numbered_heading")
        .when(F.col("backed_by").isNotNull(), "dropped_toc_echo")
        .when(F.col("drop_reason") == "implausible", "dropped_long_candidate")
    )
    severity = F.create_map(*[F.lit(x) for x in ("dropped_toc_backed", "high", "dropped_numbered_heading", "warn", "dropped_toc_echo", "info", "dropped_long_candidate", "info")])
    return rows.withColumn("check", check).filter("check is not null").select("source_id", "gid", "check", severity[F.col("check")].alias("severity"), "backed_by")


def contents_unavailable(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """C10: sources without a contents list."""
    return sources.select("source_id").distinct().join(entries.select("source_id").distinct(), "source_id", "left_anti").select("source_id", F.lit("toc_unavailable").alias("check"), F.lit("warn").alias("severity"))


def calibration_missing(sources: DataFrame, segs: DataFrame) -> DataFrame:
    """C20: sources without any calibrated segment."""
    return sources.select("source_id").distinct().join(segs.select("source_id").distinct(), "source_id", "left_anti").select("source_id", F.lit("calib_missing").alias("check"), F.lit("high").alias("severity"))


def summary(findings: DataFrame) -> DataFrame:
    """Counts by severity and the verdict of each source."""
    n = {s: F.count_if(F.col("severity") == s).alias(s) for s in ("high", "warn", "info")}
    out = findings.groupBy("source_id").agg(*n.values())
    return out.withColumn("verdict", F.when(F.col("high") > 0, "fail").when(F.col("warn") > 0, "warn").otherwise("pass"))


def ordered_ids(findings: DataFrame) -> DataFrame:
    """Findings with an id and their place in a report: by severity, then by id."""
    w = Window.partitionBy("source_id").orderBy("check", "seq")
    rows = findings.withColumn("id", F.concat(F.upper(F.substring("check", 1, 4)), F.lit("-"), F.lpad(F.row_number().over(w).cast("string"), 3, "0")))
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy(rank, "id")))
