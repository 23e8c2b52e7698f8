"""Book-shaped views over the star-schema tables, for queries and benches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import table


def page_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, shard_ord, page_idx, printed, event_type, event_id: printed numbers seen on pages."""
    by = Window.partitionBy("source_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 20).alias("source_id"))
    e = e.withColumn("n", (F.row_number().over(by) - 1).cast("long"))
    e = e.filter("event_id % 13 <> 0").selectExpr("*", "n div 200 + 1 as shard_ord", "n % 200 as page_idx")
    return e.selectExpr(
        "source_id", "shard_ord", "page_idx", "event_type", "event_id",
        "page_idx + case when shard_ord = 1 and page_idx < 10 + source_id % 5 then 1 else 200 * (shard_ord - 1) - 9 - source_id % 5 end"
        " + case when source_id % 4 = 3 and page_idx >= 120 then 2 else 0 end + case when event_id % 61 = 0 then 500 else 0 end as printed",
    )


def mixed_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_observations with headers as a second kind, some of them on a page that has a number."""
    o = page_observations(spark, sf_dir)
    kind = F.when(F.col("event_type") == "view", "header").otherwise("page_number")
    first = o.withColumn("kind", kind)
    again = o.filter("event_id % 17 = 0").withColumn("printed", F.col("printed") + 1).withColumn("kind", F.lit("header"))
    return first.unionByName(again)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, gid, shard_ord, page_idx, type, text, text_level: a block for each line of a document."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.posexplode(F.split("text", "\n")).alias("gid", "text"))
    d = d.withColumn("gid", F.col("gid").cast("long")).withColumn("k", F.expr("(source_id * 31 + gid * 7) % 20"))
    kinds = ("header", "footer", "image", "table", "page_footnote", "list", "sidebar")
    kind = F.when(F.col("k") < len(kinds), F.element_at(F.array(*map(F.lit, kinds)), F.least(F.col("k"), F.lit(len(kinds) - 1)).cast("int") + 1)).otherwise("text")
    return d.select("source_id", "gid", F.expr("gid div 40 + 1").alias("shard_ord"), F.expr("gid % 40 div 4").alias("page_idx"), kind.alias("type"), "text", F.expr("case when length(text) <= 60 then 1 + gid % 2 end").alias("text_level"))


def rich_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blocks whose pictures and tables have paths, bodies, captions and notes, some of them nothing else."""
    b = blocks(spark, sf_dir)
    return b.selectExpr(
        "source_id", "gid", "shard_ord", "page_idx", "type", "case when type = 'table' and gid % 3 <> 1 then '' else text end as text", "text_level",
        "case when type = 'image' and gid % 4 <> 3 then concat('scan/images/', gid, '.png') else '' end as img_path",
        "case when type = 'table' and gid % 3 <> 1 then concat('<table><tr><td>', text, '</td></tr></table>') else '' end as table_body",
        "case when type not in ('image', 'table') or gid % 3 = 2 then cast(array() as array<string>) when gid % 3 = 0 then array(concat('Caption ', gid)) else array(concat('Caption ', gid), 'and more') end as caption",
        "case when type in ('image', 'table') and gid % 2 = 0 then array(concat('Note of ', gid)) else cast(array() as array<string>) end as footnote",
    )


TIER_NAMES = ("part", "chapter", "sec", "dun", "paren_zh", "paren_ar", "arabic")


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, seq, level, title, tier, number, page_idx, chars, blocks: an outline for each order."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x = table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(by).cast("long"))
    x = x.select(
        F.col("l_orderkey").alias("source_id"), "seq", (1 + F.col("l_partkey") % 4).alias("level"), (F.col("l_suppkey") % 7).alias("t"),
        (F.col("seq") + F.when(F.col("l_partkey") % 5 == 0, 1).otherwise(0)).alias("number"),
        (F.col("seq") * 3 + F.when(F.col("l_suppkey") % 9 == 0, -4).otherwise(0)).alias("page_idx"), F.col("l_quantity").cast("long").alias("chars"),
    )
    digits = F.lit("零一二三四五六七八九")
    one = F.substring(digits, (F.col("number") % 10 + 1).cast("int"), F.lit(1))
    zh = F.when(F.col("number") < 10, one).when(F.col("number") == 10, "十").otherwise(F.concat(F.lit("十"), one))
    n = F.col("number").cast("string")
    forms = (("第", zh, "部分"), ("第", zh, "章"), ("第", zh, "节"), ("", zh, "、"), ("（", zh, "）"), ("（", n, "）"), ("", n, "."))
    title = F.lit(None).cast("string")
    for k, (a, v, b) in enumerate(forms):
        title = F.when(F.col("t") == k, F.concat(F.lit(a), v, F.lit(b))).otherwise(title)
    return x.select("source_id", "seq", "level", title.alias("title"), F.col("number").cast("long").alias("number"), "page_idx", "chars", F.lit(1).cast("long").alias("blocks"), F.col("t").alias("tier_no"))


def overlay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(levels, deleted, added) by source and gid, from the labels."""
    x = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_id"), "quality", "toxic")
    levels = x.filter("toxic = 0").select("source_id", F.expr("source_id % 7").alias("gid"), (1 + F.col("quality")).cast("long").alias("level"))
    deleted = x.filter("toxic = 1").select("source_id", F.expr("source_id % 7").alias("gid"))
    added = x.filter("quality = 1 and source_id % 3 = 0").select("source_id", F.expr("source_id % 5").alias("gid"), F.concat(F.lit("added "), F.col("source_id")).alias("title"), F.lit(2).cast("long").alias("level"))
    return levels, deleted, added


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, event_seq, stage, cursor: the events of each job in order, and how far it was told."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("job_id"), F.row_number().over(by).cast("long").alias("event_seq"), F.col("event_type").alias("stage"), (F.col("user_id") % 7).alias("cursor"))
