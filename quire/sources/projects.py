"""OCR projects: content lists of either format to blocks, listings, shard plans."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions.text import squeeze, strip

SHARD_PAGES = 200


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, dir, name) of the JSON files below a path that Spark can read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path).select("path")
    return files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))


def content_lists(files: DataFrame) -> DataFrame:
    """The content list of each dir of files(dir, name, ..); a name not ending in _v2 is preferred, then the first."""
    order = Window.partitionBy("dir").orderBy(F.col("name").endswith("_v2.json"), "name")
    own = files.filter(F.col("name").endswith("content_list.json") | F.col("name").endswith("content_list_v2.json"))
    return own.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def discovered(files: DataFrame, keyword: str) -> DataFrame:
    """The content lists of the directories whose own name holds a keyword."""
    return content_lists(files).filter(F.regexp_extract("dir", r"([^/]*)/*$", 1).contains(keyword))


def raw_items(documents: DataFrame) -> DataFrame:
    """(source_id, shard_ord, local, item variant) of documents(source_id, shard_ord, json); items without a type are left out.

    Both formats: fields at the top, or inside ``content``. A document that isn't a list fails.
    """
    is_list = F.expr("schema_of_variant(parse_json(json)) like 'ARRAY%'")
    rows = documents.withColumn("_ok", F.when(is_list, True).otherwise(F.raise_error(F.lit("a content list must be a JSON list"))))
    rows = rows.filter("_ok").select("source_id", "shard_ord", F.expr("parse_json(json)").alias("v"))
    rows.createOrReplaceTempView("_quire_lists")
    out = rows.sparkSession.sql("SELECT source_id, shard_ord, cast(x.pos as bigint) AS local, x.value AS item FROM _quire_lists, LATERAL variant_explode(v) AS x")
    kind = F.expr("coalesce(try_variant_get(item, '$.type', 'string'), try_variant_get(item, '$.content.type', 'string'))")
    return out.withColumn("type", kind).filter("type is not null")


def field(name: str, kind: str) -> Column:
    """A field of an item, wherever its format has it."""
    return F.expr(f"coalesce(try_variant_get(item, '$.{name}', '{kind}'), try_variant_get(item, '$.content.{name}', '{kind}'))")


def texts(name: str) -> Column:
    return F.coalesce(field(name, "array<string>"), F.array().cast("array<string>"))


def raw_text(items: DataFrame) -> DataFrame:
    """items with ``text`` as it stands in their text, or else in their list, a string to a line, blanks and all."""
    return items.withColumn("text", F.coalesce(field("text", "string"), F.array_join(texts("list_items"), "\n")))


def nested_text(value: object) -> str:
    """The text of a payload: strings, lists and items in one another, of any depth, a piece to a line."""
    if isinstance(value, str):
        return value.strip()
    if value is None:
        return ""
    if isinstance(value, list):
        return "\n".join(t for t in map(nested_text, value) if t)
    if isinstance(value, dict):
        text, listed = nested_text(value.get("text")), nested_text(value.get("list_items"))
        again = "".join(listed.split()) in "".join(text.split())
        return text if again else "\n".join(t for t in (text, listed) if t)
    raise ValueError(f"a text can't be a {type(value).__name__}")


@F.udf(StringType(), useArrow=True)
def _nested(payload: str | None) -> str:
    return nested_text(json.loads(payload) if payload else None)


def item_text(items: DataFrame) -> DataFrame:
    """items with ``text``: that of each item and of its list, unless the text has the list already.

    Strings and lists of strings are read by expressions; what nests deeper goes through
    Python, and numbers and truth values as texts are errors.
    """
    kind = lambda name: F.expr(f"schema_of_variant(coalesce(try_variant_get(item, '$.{name}', 'variant'), try_variant_get(item, '$.content.{name}', 'variant')))")
    flat = lambda name: F.coalesce(kind(name).isin("STRING", "VOID", "ARRAY<STRING>", "ARRAY<VOID>"), F.lit(True))
    one = lambda name: F.when(F.coalesce(kind(name) == "STRING", F.lit(False)), strip(F.coalesce(field(name, "string"), F.lit("")))).otherwise(F.array_join(F.filter(F.transform(texts(name), strip), lambda x: x != ""), "\n"))
    rows = items.withColumn("_flat", flat("text") & flat("list_items"))
    plain = rows.filter("_flat").withColumns({"_t": one("text"), "_l": one("list_items")})
    again = squeeze("_t").contains(squeeze("_l"))
    plain = plain.withColumn("text", F.when(again, F.col("_t")).when(F.col("_t") == "", F.col("_l")).otherwise(F.concat("_t", F.lit("\n"), "_l"))).drop("_t", "_l")
    payload = F.to_json(F.expr("coalesce(try_variant_get(item, '$.content', 'variant'), item)"))
    top = F.expr("try_variant_get(item, '$.text', 'variant') is not null or try_variant_get(item, '$.list_items', 'variant') is not null")
    deep = rows.filter("not _flat").withColumn("text", _nested(F.when(top, F.to_json("item")).otherwise(payload)))
    return plain.unionByName(deep).drop("_flat")


def blocks(items: DataFrame) -> DataFrame:
    """Blocks with a number over all shards of a source; the first caption field that has anything counts."""
    first = lambda kind: F.coalesce(*[F.when(F.size(texts(f"{k}_{kind}")) > 0, texts(f"{k}_{kind}")) for k in ("image", "table", "chart")], F.array().cast("array<string>"))
    gid = F.row_number().over(Window.partitionBy("source_id").orderBy("shard_ord", "local")) - 1
    level = field("text_level", "string")
    return item_text(items).select(
        "source_id", gid.cast("long").alias("gid"), "shard_ord", "local", F.coalesce(field("page_idx", "long"), F.lit(0)).alias("page_idx"), "type", "text",
        F.when(level.rlike(r"^-?[0-9]+$"), level.try_cast("long")).alias("text_level"), F.coalesce(field("img_path", "string"), F.lit("")).alias("img_path"), F.coalesce(field("table_body", "string"), F.lit("")).alias("table_body"),
        first("caption").alias("caption"), first("footnote").alias("footnote"), F.coalesce(field("_trusted", "boolean"), F.lit(False)).alias("level_trusted"),
    )


def shard_tag(directory: Column | str, position: Column | str) -> Column:
    """P and the number at a directory name's end, or at its start, or its place."""
    d = F.col(directory) if isinstance(directory, str) else directory
    p = F.col(position) if isinstance(position, str) else position
    n = F.coalesce(F.nullif(F.regexp_extract(d, r"_P(\d+)$", 1), F.lit("")), F.nullif(F.regexp_extract(d, r"^(\d+)", 1), F.lit("")), p.cast("string"))
    return F.concat(F.lit("P"), n.cast("long"))


def planned_shards(sources: DataFrame, pages: int = SHARD_PAGES) -> DataFrame:
    """Page ranges for sources(source_id, n_pages): pieces of 200, no range for a single one, a pending one where the length is unknown."""
    starts = F.when(F.coalesce("n_pages", F.lit(0)) > 0, F.sequence(F.lit(0).cast("long"), F.col("n_pages") - 1, F.lit(pages).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    rows = sources.withColumn("_n", F.size(starts)).select("source_id", "n_pages", "_n", F.posexplode(starts).alias("k", "at"))
    span = F.when(F.col("_n") > 1, F.concat(F.col("at") + 1, F.lit("-"), F.least(F.col("at") + pages, F.col("n_pages"))))
    return rows.select("source_id", (F.col("k") + 1).cast("long").alias("shard_ord"), span.alias("page_range"), F.when(F.col("n_pages") > 0, F.least(F.lit(pages), F.col("n_pages") - F.col("at"))).alias("expect_pages"), F.lit("pending").alias("state"))


def resolved(names: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, source_id, candidates) of asked(asked): the source of names(source_id) that each means.

    The one of that name; or else the only one that begins with it; or else the only one that
    holds it. With several or none, source_id is null and candidates says how many. What is
    asked is what people typed, so it is few rows and goes to every task.
    """
    asked = asked.distinct()
    hits = names.select("source_id").distinct().join(F.broadcast(asked), F.col("source_id").contains(F.col("asked")))
    rows = asked.join(hits, "asked", "left")
    same, begins = F.col("source_id") == F.col("asked"), F.col("source_id").startswith(F.col("asked"))
    by = rows.groupBy("asked").agg(
        F.max(F.when(same, F.col("source_id"))).alias("same"), F.count_if(begins).alias("n_begin"), F.max(F.when(begins, F.col("source_id"))).alias("begin"), F.count("source_id").alias("n_hold"), F.max("source_id").alias("hold"),
    )
    count = F.when(F.col("same").isNotNull(), 1).when(F.col("n_begin") > 0, F.col("n_begin")).otherwise(F.col("n_hold"))
    found = F.when(F.col("same").isNotNull(), F.col("same")).when(F.col("n_begin") == 1, F.col("begin")).when((F.col("n_begin") == 0) & (F.col("n_hold") == 1), F.col("hold"))
    return by.select("asked", found.alias("source_id"), count.cast("long").alias("candidates"))


def resolve(names: DataFrame, asked: str) -> str:
    """The one source that a user means; several or none is an error."""
    row = resolved(names, names.sparkSession.createDataFrame([(asked,)], "asked string")).first()
    if row["source_id"] is None:
        raise LookupError(f"{asked!r} means {row['candidates']} sources")
    return row["source_id"]
