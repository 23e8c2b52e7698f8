"""Verification gates over what was rendered, and over the calibration it used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_content, squeeze

#: The gates' thresholds.
ANCHORS_PASS, ANCHORS_WARN, LOSSLESS_WARN = 0.95, 0.80, 0.99


def anchor_coverage(content: DataFrame, locator_type: DataFrame) -> DataFrame:
    """G1: the share of content blocks(source_id, locator) on pages with a locator."""
    rate = content.groupBy("source_id").agg(F.count("*").alias("blocks"), F.count("locator").alias("located"))
    rows = locator_type.select("source_id", "locator_type").join(rate, "source_id", "left").withColumns({"blocks": F.coalesce("blocks", F.lit(0)), "located": F.coalesce("located", F.lit(0))})
    share = F.bround(F.try_divide("located", "blocks"), 4)
    status = F.when(F.col("blocks") == 0, "skip").when(F.col("locator_type") == "section_only", "warn").when(share >= ANCHORS_PASS, "pass").when(share >= ANCHORS_WARN, "warn").otherwise("fail")
    return rows.select("source_id", "blocks", "located", share.alias("rate"), status.alias("status"))


def lossless(indexed: DataFrame, files: DataFrame) -> DataFrame:
    """G2: every field of indexed(source_id, path, text) is in its file(source_id, path, content), whitespace aside.

    A file's fields meet it as one row, so its text is read once and not once for each field.
    """
    plain = squeeze(F.regexp_replace(F.coalesce("content", F.lit("")), r"<!--[^\n]*-->", ""))
    own = indexed.select("source_id", "path", squeeze("text").alias("own")).filter("own <> ''").groupBy("source_id", "path").agg(F.collect_list("own").alias("own"))
    rows = own.join(files.select("source_id", "path", plain.alias("plain")), ["source_id", "path"], "left")
    n = F.size("own")
    missing = F.when(F.col("plain").isNotNull(), F.size(F.filter("own", lambda x: ~F.col("plain").contains(x)))).otherwise(0)
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    out = rows.groupBy("source_id").agg(total(n, "blocks"), total(missing, "missing"), total(F.when(F.col("plain").isNull(), n).otherwise(0), "without_file"))
    rate = 1 - F.col("missing") / F.col("blocks")
    return out.withColumn("status", F.when(F.col("missing") == 0, "pass").when(rate >= LOSSLESS_WARN, "warn").otherwise("fail"))


def page_consistency(segs: DataFrame, checks: DataFrame) -> DataFrame:
    """G3: segments are as long in print as in pages; weak ones and breaks warn."""
    own = segs.groupBy("source_id").agg(F.count_if(F.expr("printed_end - printed_start <> page_end - page_start")).alias("broken"), F.count_if(F.col("confidence") == "low").alias("low"))
    breaks = checks.groupBy("source_id").agg(F.count_if(~F.col("ok")).alias("breaks"))
    rows = own.join(breaks, "source_id", "left").withColumn("breaks", F.coalesce("breaks", F.lit(0)))
    return rows.withColumn("status", F.when(F.col("broken") > 0, "fail").when((F.col("low") > 0) | (F.col("breaks") > 0), "warn").otherwise("pass"))


def anchors_present(files: DataFrame, locator_type: DataFrame) -> DataFrame:
    """G4: some file has a page anchor, unless the source has no pages."""
    has = files.groupBy("source_id").agg(F.bool_or(F.col("content").rlike(r"(^|\n)<!-- p=")).alias("has"))
    rows = locator_type.select("source_id", "locator_type").join(has, "source_id", "left")
    ok = F.coalesce("has", F.lit(False)) | (F.col("locator_type") == "section_only")
    return rows.select("source_id", F.when(ok, "pass").otherwise("fail").alias("status"))


def overall(gates: DataFrame) -> DataFrame:
    """G5: the verdict over gates(source_id, gate, status)."""
    out = gates.groupBy("source_id").agg(F.bool_or(F.col("status") == "fail").alias("f"), F.bool_or(F.col("status") == "warn").alias("w"), F.count("*").alias("gates"))
    return out.select("source_id", "gates", F.when(F.col("f"), "fail").when(F.col("w"), "warn").otherwise("pass").alias("verdict"))


def full_coverage(blocks: DataFrame, pieces: DataFrame) -> DataFrame:
    """G6: every content block(source_id, gid, type, text) is whole in its exported pieces(source_id, gid, part, text)."""
    told = pieces.groupBy("source_id", "gid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("told"))
    rows = blocks.filter(is_content("type")).join(told, ["source_id", "gid"], "left")
    lost = squeeze(F.coalesce("told", F.lit(""))) != squeeze(F.coalesce("text", F.lit("")))
    out = rows.groupBy("source_id").agg(F.count("*").alias("blocks"), F.count_if(lost).alias("lost"))
    return out.withColumn("status", F.when(F.col("lost") == 0, "pass").otherwise("fail"))
