"""Work around the operators: evidence windows, guards on proposed changes, identities, job stages, file sinks."""

from __future__ import annotations

import base64
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import squeeze, strip

WINDOWS, AROUND_GID, AROUND_RANGE = 20, 4, 2
#: The stages of a job and where each may lead.
STAGES = {
    "received": ("ocr_running", "failed"),
    "ocr_running": ("needs_ai_review", "failed"),
    "needs_ai_review": ("reviewed", "failed"),
    "reviewed": ("validated", "needs_review", "failed"),
    "needs_review": ("reviewed", "failed"),
    "validated": ("archive_prepared", "failed"),
    "archive_prepared": ("archiving", "failed"),
    "archiving": ("completed", "failed"),
}


def probe_windows(probes: DataFrame, blocks: DataFrame, most: int = WINDOWS) -> DataFrame:
    """The blocks to read for probes(source_id, probe, gid_start, gid_end[, shard_ord, page_idx, why]): two around a range or a page, four around a single block.

    A probe without a block means a page of a shard, as pages count from 0 in each shard; one
    with neither has no window. Windows that come out alike count once, and a source has at
    most ``most``, the first ones.
    """
    names = probes.columns
    why = F.col("why") if "why" in names else F.lit(None).cast("string")
    rows = probes.withColumn("_why", why)
    first, past = F.col("gid_start"), F.coalesce("gid_end", "gid_start")
    if "page_idx" in names:
        pages = blocks.groupBy("source_id", "shard_ord", "page_idx").agg(F.min("gid").alias("_from"), F.max("gid").alias("_to"))
        rows = rows.join(pages, ["source_id", "shard_ord", "page_idx"], "left")
        first, past = F.coalesce("gid_start", "_from"), F.coalesce("gid_end", "gid_start", "_to")
    one = F.col("gid_end").isNull() & F.col("gid_start").isNotNull()
    around = F.when(one, AROUND_GID).otherwise(AROUND_RANGE)
    last = blocks.groupBy("source_id").agg(F.max("gid").alias("last"))
    rows = rows.join(last, "source_id").select("source_id", "probe", "_why", F.greatest(first - around, F.lit(0)).alias("low"), F.least(past + around, F.col("last")).alias("high")).filter("low <= high and low is not null")
    rows = rows.groupBy("source_id", "low", "high").agg(F.min(F.struct("probe", "_why")).alias("p")).select("source_id", "low", "high", "p.probe", F.col("p._why").alias("why"))
    rows = rows.withColumn("window", F.row_number().over(Window.partitionBy("source_id").orderBy("probe", "low"))).filter(F.col("window") <= most)
    spread = rows.withColumn("gid", F.explode(F.sequence("low", "high")))
    return spread.join(blocks.select("source_id", "gid", "text"), ["source_id", "gid"]).select("source_id", "window", "probe", "gid", "text", "why")


def refused_operations(operations: DataFrame, tree: DataFrame, blocks: DataFrame) -> DataFrame:
    """Why proposed operations(source_id, item, action, key, gid, title) are refused.

    Deletions of front matter or of nodes with children, keys or blocks named twice, blocks that
    aren't there, titles that their block doesn't hold.
    """
    per_key, per_gid = Window.partitionBy("source_id", "action", "key"), Window.partitionBy("source_id", "action", "gid")
    children = tree.filter("parent is not null").groupBy("source_id", F.col("parent").cast("string").alias("key")).agg(F.count("*").alias("children"))
    nodes = tree.select("source_id", "key", F.col("marker").alias("node_marker"))
    rows = operations.withColumn("same_key", F.count("key").over(per_key)).withColumn("same_gid", F.count("gid").over(per_gid))
    rows = rows.join(nodes, ["source_id", "key"], "left").join(children, ["source_id", "key"], "left").join(blocks.select("source_id", "gid", F.col("text").alias("block_text")), ["source_id", "gid"], "left")
    gone, add = F.col("action") == "delete", F.col("action") == "add"
    reasons = F.array_compact(F.array(
        F.when(gone & (F.col("node_marker") == "front"), F.lit("front matter")), F.when(gone & (F.col("children") > 0), F.lit("has children")), F.when(F.col("key").isNotNull() & F.col("node_marker").isNull(), F.lit("unknown key")),
        F.when(F.col("same_key") > 1, F.lit("key twice")), F.when(add & (F.col("same_gid") > 1), F.lit("block twice")), F.when(add & F.col("block_text").isNull(), F.lit("no such block")),
        F.when(add & F.col("block_text").isNotNull() & ~squeeze("block_text").contains(squeeze("title")), F.lit("title isn't in its block")),
    ))
    return rows.select("source_id", "item", F.explode(reasons).alias("reason"))


def evidence(findings: DataFrame, prefixes: tuple[str, ...], most: int = 40) -> DataFrame:
    """Findings worth showing: high ones and those of some checks, the first of each source."""
    own = findings.filter((F.col("severity") == "high") | F.col("check").rlike("^(" + "|".join(prefixes) + ")"))
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("check", "seq"))
    return own.withColumn("n", n).filter(F.col("n") <= most)


def global_places(rows: DataFrame, first: str, then: str, width: int = 65536) -> DataFrame:
    """rows with ``place`` in the order of two whole numbers, numbered in ranges of the second and moved by the rows before each range."""
    rows = rows.withColumn("_r", F.floor(F.col(then) / width))
    nulls_last = [F.asc_nulls_last(c) for c in (first, "_r")]
    counts = rows.groupBy(first, "_r").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*nulls_last).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = counts.select(F.col(first).alias("_f"), F.col("_r").alias("_q"), before.alias("_before"))
    own = rows.withColumn("_k", F.row_number().over(Window.partitionBy(first, "_r").orderBy(then)))
    out = own.join(moved, own[first].eqNullSafe(moved["_f"]) & own["_r"].eqNullSafe(moved["_q"]))
    return out.withColumn("place", F.col("_before") + F.col("_k")).drop("_r", "_f", "_q", "_k", "_before")


def first_of(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The first rows of each source, as lists in reports are cut."""
    n = F.row_number().over(Window.partitionBy("source_id").orderBy(order))
    return rows.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def identity(*parts: Column | str, length: int = 24) -> Column:
    """An engine-local identity of parts: the beginning of their joint digest."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length)


def table_revision(rows: DataFrame, order: str, *columns: str) -> DataFrame:
    """Per source a digest over its rows in order, which changes whenever a row does."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("d"))))
    return rows.groupBy("source_id").agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["d"]), ""), 256).alias("revision"))


def illegal_moves(events: DataFrame) -> DataFrame:
    """Steps of jobs(job_id, event_seq, stage) that their stage doesn't lead to."""
    before = F.lag("stage").over(Window.partitionBy("job_id").orderBy("event_seq"))
    legal = F.create_map(*[x for s, to in STAGES.items() for x in (F.lit(s), F.array(*map(F.lit, to)))])
    rows = events.withColumn("before", before).filter("before is not null and before <> stage")
    return rows.filter(~F.coalesce(F.array_contains(F.try_element_at(legal, F.col("before")), F.col("stage")), F.lit(False))).select("job_id", "event_seq", "before", "stage")


def current_stage(events: DataFrame) -> DataFrame:
    """Where each job is: its last stage, how many events led there."""
    return events.groupBy("job_id").agg(F.max_by("stage", "event_seq").alias("stage"), F.max("event_seq").alias("event_seq"), F.count("*").alias("events"))


def shard_states(states: DataFrame, news: DataFrame) -> DataFrame:
    """states(source_id, shard_ord, state, at) after news of the same kind: the latest of each shard counts."""
    both = states.unionByName(news)
    return both.groupBy("source_id", "shard_ord").agg(F.max_by(F.struct("state", "at"), "at").alias("s")).select("source_id", "shard_ord", "s.state", "s.at")


def unfinished(states: DataFrame) -> DataFrame:
    """Sources with shards that aren't done: how many, and how many failed."""
    out = states.groupBy("source_id").agg(F.count("*").alias("shards"), F.count_if(F.col("state") == "unzipped").alias("done"), F.count_if(F.col("state").isin("failed", "ocr_failed")).alias("failed"))
    return out.filter("done < shards")


def fidelity(sources: DataFrame, rendered: DataFrame) -> DataFrame:
    """Characters without whitespace of rendered(source_id, content) against those of sources(source_id, text).

    A source without characters has the ratio infinity, or NaN if no text is rendered either. The
    scaled ratio is rounded, ties to even.
    """
    count = lambda df, c, name: df.groupBy("source_id").agg(F.sum(F.length(squeeze(c)).cast("long")).alias(name))
    rows = count(sources, "text", "source_chars").join(count(rendered, "content", "rendered_chars"), "source_id", "left")
    told = F.coalesce("rendered_chars", F.lit(0))
    empty = F.when(told == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return rows.withColumn("ratio", F.when(F.col("source_chars") == 0, empty).otherwise(F.rint(F.try_divide(told, "source_chars") * 10000) / 10000))


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes files(source_id, path, content) below a folder of any file system that Spark knows; returns (source_id, path, bytes, sha256) of what was written.

    Each file is written once under a temporary name and renamed, by the machine that has its
    rows; paths that lead outside are an error. A task that runs again writes the same files.
    """
    spark = files.sparkSession
    bad = F.col("path").startswith("/") | F.concat(F.lit("/"), "path", F.lit("/")).contains("/../")
    rows = files.withColumn("path", F.when(bad, F.raise_error(F.concat(F.col("path"), F.lit(" lies outside")))).otherwise(F.col("path")))
    rows = rows.select("source_id", "path", F.encode("content", "utf-8").alias("raw"))
    staged = f"{root.rstrip('/')}/.staged-{uuid.uuid4().hex}"
    rows.select(F.concat_ws("/", F.col("source_id").cast("string"), "path").alias("name"), F.base64("raw").alias("raw")).write.parquet(staged)
    fs, path = _file_system(spark, staged)
    made = spark.read.parquet(staged)
    for r in made.toLocalIterator():
        target = f"{root.rstrip('/')}/{r['name']}"
        part = spark._jvm.org.apache.hadoop.fs.Path(f"{target}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(part, True)
        stream.write(base64.b64decode(r["raw"]))
        stream.close()
        goal = spark._jvm.org.apache.hadoop.fs.Path(target)
        if fs.exists(goal):
            fs.delete(goal, False)
        fs.rename(part, goal)
    fs.delete(path, True)
    return rows.select("source_id", "path", F.length("raw").cast("long").alias("bytes"), F.sha2("raw", 256).alias("sha256"))


def _file_system(spark, where: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def rewritten_links(index: DataFrame, moved: DataFrame) -> DataFrame:
    """Lines(source_id, ord, line) of an index with the targets of Markdown links replaced by moved(source_id, path, target)."""
    rows = index.withColumn("path", F.regexp_extract("line", r"\]\(([^)]+)\)", 1))
    out = rows.join(moved, ["source_id", "path"], "left")
    new = F.when(F.col("target").isNotNull(), F.replace("line", F.concat(F.lit("]("), F.col("path"), F.lit(")")), F.concat(F.lit("]("), F.col("target"), F.lit(")")))).otherwise(F.col("line"))
    return out.select("source_id", "ord", new.alias("line"))


def reply_problems(items: DataFrame) -> DataFrame:
    """What is wrong with a reviewer's reply items(source_id, item, kind, action, evidence, scope_evidence, target, question)."""
    t = lambda c: F.coalesce(strip(c), F.lit(""))
    known = F.col("action").isin("level", "add", "delete", "delete-clear", "level-clear", "add-clear")
    reasons = F.array_compact(F.array(
        F.when((F.col("kind") == "operation") & ~F.coalesce(known, F.lit(False)), F.lit("unknown action")), F.when(F.col("kind").isin("operation", "page_fix") & (t("evidence") == ""), F.lit("no evidence")),
        F.when((F.col("kind") == "page_fix") & (t("scope_evidence") == ""), F.lit("no scope evidence")), F.when((F.col("kind") == "unresolved") & ((t("target") == "") | (t("question") == "")), F.lit("no question")),
    ))
    return items.select("source_id", "item", F.explode(reasons).alias("reason"))
