"""Changing the overlay: additions, anchors, whole plans, previews, rounds of review, and their history.

A plan's items become events on the overlay's four tables. The last event on a key decides,
as if the items had been carried out one after the other, so a plan of any size for any
number of sources is one aggregation and one anti join for each table. Every function gives
new tables and leaves the old ones as they are: they are the backup.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.operators.overlay import LEAST_LEVEL, MOST_LEVEL, node_key, remove, upsert

MOST_ROUNDS = 2
#: Actions that change pages, after which a source is calibrated anew.
PAGE_ACTIONS = ("anchor", "anchor-clear")
PART_LIMITS = {"findings": (40, 40, 40), "windows": (20, 10, 6), "starts": (60, 30, 0), "page_texts": (150, 80, 40), "observations": (200, 120, 80)}


class Corrections(NamedTuple):
    """levels(source_id, key, level), deleted(source_id, key), added(source_id, gid, title, level, offset), anchors(source_id, shard_ord, page_idx, printed)."""

    levels: DataFrame
    deleted: DataFrame
    added: DataFrame
    anchors: DataFrame


# --- single tables -------------------------------------------------------------------


def set_added(added: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(additions after changes(source_id, gid string, title, level, offset), refused changes with ``error``).

    A place is a block number, a title isn't empty, a level is 1 to 9, an offset at least 0.
    """
    gid = node_key("gid")
    error = F.when(~F.coalesce(gid.rlike(r"^[0-9]+\z"), F.lit(False)), "no block number").when(F.coalesce(strip("title"), F.lit("")) == "", "no title").when(~F.coalesce(F.col("level").between(LEAST_LEVEL, MOST_LEVEL), F.lit(False)), "level out of range")
    rows = changes.withColumn("error", error)
    good = rows.filter("error is null").select("source_id", gid.try_cast("long").alias("gid"), strip("title").alias("title"), F.col("level").cast("long").alias("level"), F.greatest(F.lit(0), F.coalesce("offset", F.lit(0))).cast("long").alias("offset"))
    return upsert(added, good, ("source_id", "gid")), rows.filter("error is not null").select("source_id", "gid", "error")


def clear_added(added: DataFrame, places: DataFrame) -> DataFrame:
    """Additions without those at places(source_id, gid)."""
    return remove(added, places, ("source_id", "gid"))


def set_anchors(anchors: DataFrame, changes: DataFrame) -> DataFrame:
    """Anchors with changes(source_id, shard_ord, page_idx, printed) in place of those on the same pages."""
    return upsert(anchors, changes.select("source_id", "shard_ord", "page_idx", "printed"), ("source_id", "shard_ord", "page_idx"))


def clear_anchors(anchors: DataFrame, which: DataFrame) -> DataFrame:
    """Anchors without those of which: single pages, shards or whole sources, by the columns that it has."""
    return remove(anchors, which, tuple(c for c in ("source_id", "shard_ord", "page_idx") if c in which.columns))


def reset(corrections: Corrections, sources: DataFrame) -> tuple[Corrections, Corrections]:
    """(corrections without those of sources(source_id), what they were): back to the automatic result, with a backup."""
    ids = sources.select("source_id").distinct()
    return Corrections(*[t.join(ids, "source_id", "left_anti") for t in corrections]), Corrections(*[t.join(ids, "source_id", "left_semi") for t in corrections])


# --- plans ---------------------------------------------------------------------------


def read_items(items: DataFrame) -> DataFrame:
    """items(source_id, item, action, fields map<string,string>) with their fields read and ``error`` where they can't be carried out."""
    field = lambda name: F.try_element_at(F.col("fields"), F.lit(name))
    pairs = F.from_json(field("pairs"), "map<string,bigint>")
    rows = items.select(
        "source_id", "item", "action", "fields", node_key(field("key")).alias("key"), field("level").try_cast("long").alias("level"), pairs.alias("pairs"), node_key(field("gid")).alias("gid"), strip(F.coalesce(field("title"), F.lit(""))).alias("title"),
        F.greatest(F.lit(0), F.coalesce(field("offset").try_cast("long"), F.lit(0))).cast("long").alias("offset"), F.regexp_extract(F.coalesce(field("shard"), F.lit("")), r"^P?([0-9]+)\z", 1).try_cast("long").alias("shard_ord"),
        field("page_idx").try_cast("long").alias("page_idx"), field("printed").try_cast("long").alias("printed"),
    )
    bad_level = ~F.coalesce(F.col("level").between(LEAST_LEVEL, MOST_LEVEL), F.lit(False))
    bad_pair = F.coalesce(F.exists(F.map_values("pairs"), lambda v: ~F.coalesce(v.between(LEAST_LEVEL, MOST_LEVEL), F.lit(False))), F.lit(True))
    is_add, is_anchor = F.col("action") == "add", F.col("action").isin(*PAGE_ACTIONS)
    error = (
        F.when((F.col("action") == "level") & bad_level, "level out of range")
        .when((F.col("action") == "levels") & bad_pair, "level out of range")
        .when(is_add & ~F.coalesce(F.col("gid").rlike(r"^[0-9]+\z"), F.lit(False)), "no block number")
        .when(is_add & (F.col("title") == ""), "no title")
        .when(is_add & bad_level, "level out of range")
        .when(is_anchor & (F.col("shard_ord").isNull() | F.col("page_idx").isNull() | ((F.col("action") == "anchor") & F.col("printed").isNull())), "no page")
    )
    return rows.withColumn("error", error)


def last_events(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The last of events(*keys, item, value) on each key; a null value takes the key out."""
    return events.groupBy(*keys).agg(F.max_by(F.struct("value"), "item").alias("v")).select(*keys, "v.value")


def applied(corrections: Corrections, items: DataFrame) -> tuple[Corrections, DataFrame]:
    """(corrections after items, failed(source_id, item, action, error)); items that fail are passed over."""
    rows = read_items(items)
    good, a = rows.filter("error is null"), F.col("action")
    added_key = F.col("key").startswith("add:")
    pick = lambda condition, value, *keys: good.filter(condition).select("source_id", *keys, "item", value.alias("value"))
    no_level = F.lit(None).cast("long")
    levels = pick(a == "level", F.col("level"), "key").unionByName(pick(a.isin("level-clear", "delete"), no_level, "key"))
    each = good.filter(a == "levels").select("source_id", "item", F.explode("pairs").alias("key", "value")).withColumn("key", node_key("key"))
    levels = last_events(levels.unionByName(each.select("source_id", "key", "item", "value")), ("source_id", "key"))
    deleted = pick((a == "delete") & ~added_key, F.lit(True), "key").unionByName(pick(a == "delete-clear", F.lit(None).cast("boolean"), "key"))
    deleted = last_events(deleted, ("source_id", "key"))
    gid = F.col("gid").try_cast("long").alias("gid")
    made = F.struct("title", "level", "offset")
    gone = F.lit(None).cast("struct<title:string,level:bigint,offset:bigint>")
    added = pick(a == "add", made, gid).unionByName(pick(a == "add-clear", gone, gid)).unionByName(pick((a == "delete") & added_key, gone, F.substring("key", 5, 38).try_cast("long").alias("gid")))
    added = last_events(added, ("source_id", "gid"))
    page = ("shard_ord", "page_idx")
    anchors = last_events(pick(a == "anchor", F.col("printed"), *page).unionByName(pick(a == "anchor-clear", no_level, *page)), ("source_id", *page))

    def after(table: DataFrame, events: DataFrame, keys: tuple[str, ...], values: DataFrame) -> DataFrame:
        return remove(table, events, keys).select(*table.columns).unionByName(values.select(*table.columns))

    kept = lambda events: events.filter("value is not null")
    out = Corrections(
        after(corrections.levels, levels, ("source_id", "key"), kept(levels).withColumnRenamed("value", "level")), after(corrections.deleted, deleted, ("source_id", "key"), kept(deleted)),
        after(corrections.added, added, ("source_id", "gid"), kept(added).select("source_id", "gid", "value.*")), after(corrections.anchors, anchors, ("source_id", *page), kept(anchors).withColumnRenamed("value", "printed")),
    )
    return out, rows.filter("error is not null").select("source_id", "item", "action", "error")


def revision_log(plans: DataFrame, items: DataFrame, failed: DataFrame) -> DataFrame:
    """(source_id, name, applied, failed, needs_pagecal, log): what a history keeps of plans(source_id, at, name, note).

    The log says each item with its fields and what it rests on, then what failed; append it
    with ``append_history``, so that nothing written before is ever rewritten.
    """
    bad = failed.select("source_id", "item", "error")
    rows = items.join(bad, ["source_id", "item"], "left")
    fields = F.array_sort(F.map_entries(F.map_filter("fields", lambda k, v: ~k.isin("why", "snapshot") & v.isNotNull())))
    told = F.array_join(F.transform(fields, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "　")
    good = F.concat(F.lit("- `"), F.col("action"), F.lit("` "), told, F.lit("\n    - 依据："), F.coalesce("evidence", F.lit("")))
    line = F.when(F.col("error").isNull(), good).otherwise(F.concat(F.lit("- ❌ items["), F.col("item"), F.lit("] "), F.col("action"), F.lit("："), F.col("error")))
    listed = F.array_sort(F.collect_list(F.struct(F.col("error").isNotNull().alias("f"), "item", line.alias("line"))))
    by = rows.groupBy("source_id").agg(
        F.count_if(F.col("error").isNull()).alias("applied"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.bool_or(F.col("error").isNull() & F.col("action").isin(*PAGE_ACTIONS)).alias("needs_pagecal"),
        F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("lines"),
    )
    out = plans.join(by, "source_id")
    name = F.when(F.coalesce("name", F.lit("")) == "", "（未命名）").otherwise(F.col("name"))
    counts = F.concat(F.lit("　应用 "), F.col("applied"), F.lit(" 条"), F.when(F.col("failed") > 0, F.concat(F.lit("，失败 "), F.col("failed"), F.lit(" 条"))).otherwise(""))
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("- 说明："), F.col("note"), F.lit("\n"))).otherwise("")
    log = F.concat(F.lit("## "), F.col("at"), F.lit("　"), name, counts, F.lit("\n\n"), note, F.col("lines"), F.lit("\n"))
    return out.select("source_id", "name", "applied", "failed", "needs_pagecal", log.alias("log"))


def append_history(log: DataFrame, path: str) -> None:
    """Adds to a history table; what is there stays."""
    log.write.mode("append").parquet(path)


# --- previews and rounds ---------------------------------------------------------------


def previews(sources: DataFrame, operations: DataFrame, errors: DataFrame) -> DataFrame:
    """(source_id, base_revision, preview_id, operations, errors) for sources(source_id, revision): what was proposed, and on what.

    operations(source_id, item, action, fields); errors(source_id, error) refuse the preview as a whole.
    """
    row = F.concat_ws("\x1f", F.col("item").cast("string"), "action", F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], e["value"])), "\x1e"))
    ops = operations.groupBy("source_id").agg(F.count("*").alias("operations"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", row.alias("r")))), lambda x: x["r"]), "\n").alias("told"))
    bad = errors.groupBy("source_id").agg(F.count("*").alias("errors"))
    rows = sources.join(ops, "source_id", "left").join(bad, "source_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    identity = F.substring(F.sha2(F.concat_ws("\n", F.col("source_id").cast("string"), "revision", F.coalesce("told", F.lit(""))), 256), 1, 24)
    return rows.select("source_id", F.col("revision").alias("base_revision"), identity.alias("preview_id"), zero("operations"), zero("errors"))


def preview_states(made: DataFrame, revisions: DataFrame, done: DataFrame) -> DataFrame:
    """previews with ``state``: applied(preview_id) before, with errors, stale against revisions(source_id, revision), empty or ready."""
    rows = made.join(revisions, "source_id", "left").join(done.select("preview_id", F.lit(True).alias("was")), "preview_id", "left")
    state = F.when(F.col("was"), "applied").when(F.col("errors") > 0, "errors").when(~F.col("revision").eqNullSafe(F.col("base_revision")), "stale").when(F.col("operations") == 0, "nothing").otherwise("ready")
    return rows.select("source_id", "preview_id", state.alias("state"))


def apply_previews(corrections: Corrections, items: DataFrame, states: DataFrame) -> tuple[Corrections, DataFrame]:
    """(corrections, outcomes(source_id, outcome)): ready previews are applied as a whole; a source of which any item fails is left as it was."""
    ready = states.filter("state = 'ready'").select("source_id")
    own = items.join(ready, "source_id", "left_semi")
    failed = read_items(own).filter("error is not null").select("source_id").distinct()
    out, _ = applied(corrections, own.join(failed, "source_id", "left_anti"))
    rows = states.join(failed.select("source_id", F.lit(True).alias("broke")), "source_id", "left")
    outcome = F.when(F.col("state") != "ready", F.col("state")).when(F.col("broke"), "rolled back").otherwise("applied now")
    return out, rows.select("source_id", outcome.alias("outcome"))


def review_rounds(jobs: DataFrame, replies: DataFrame) -> DataFrame:
    """(job_id, outcome, stage, rounds) after replies to jobs(job_id, stage, revision, rounds).

    replies(job_id, base_revision, operations, anchors, without_evidence, without_scope, errors,
    apply, complete, review_note, unresolved, unread): two rounds of changes at most; anchors
    come first, and what else was proposed with them is read again; a review is complete
    without changes, open questions or unread nodes.
    """
    rows = jobs.join(replies, "job_id")
    c = F.col
    changes = c("operations") + c("anchors")
    noted = F.coalesce(strip("review_note"), F.lit("")) != ""
    clean = c("complete") & (changes == 0) & (c("unresolved") == 0)
    outcome = (
        F.when(~c("stage").isin("needs_ai_review", "needs_review"), "wrong stage").when(c("base_revision") != c("revision"), "stale").when((c("rounds") >= MOST_ROUNDS) & (changes > 0), "no rounds left")
        .when(c("without_evidence") > 0, "no evidence").when(c("without_scope") > 0, "no scope evidence").when(c("errors") > 0, "errors").when(~c("apply"), "dry run").when(c("complete") & ~noted, "no review note")
        .when((c("anchors") > 0) & (c("operations") > 0), "anchors applied, read again").when(clean & (c("unread") > 0), "unread nodes").when(clean, "reviewed").when(changes > 0, "applied").otherwise("noted")
    )
    rows = rows.withColumn("outcome", outcome)
    taken = c("outcome").isin("anchors applied, read again", "applied", "noted", "reviewed")
    stage = F.when(~taken, c("stage")).when(c("outcome") == "reviewed", "reviewed").when((c("outcome") != "anchors applied, read again") & (c("unresolved") > 0), "needs_review").otherwise("needs_ai_review")
    rounds = c("rounds") + F.when(c("outcome").isin("anchors applied, read again", "applied"), 1).otherwise(0)
    return rows.select("job_id", "outcome", stage.alias("stage"), rounds.alias("rounds"))


# --- packs of evidence -----------------------------------------------------------------


def evidence_packs(sources: DataFrame, nodes: DataFrame, parts: dict[str, DataFrame], limit: int = 52_000) -> DataFrame:
    """(source_id, pack, step, chars): JSON packs for sources(source_id) under a size limit.

    nodes and parts are (source_id, ord, value). Nodes are never left out; the other parts
    have their most entries, and fewer in two steps where a pack is too long. A pack that is
    too long even then is null, with step 3.
    """
    rows = sources.select("source_id").distinct()
    for name, frame in ({"nodes": nodes} | parts).items():
        most = PART_LIMITS[name][0] if name in PART_LIMITS else None
        if most is not None:
            n = F.row_number().over(Window.partitionBy("source_id").orderBy("ord"))
            frame = frame.withColumn("_n", n).filter(F.col("_n") <= most)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"])
        rows = rows.join(frame.groupBy("source_id").agg(listed.alias(name)), "source_id", "left")
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))

    def pack(step: int) -> Column:
        return F.to_json(F.struct("source_id", "nodes", *[F.slice(name, 1, PART_LIMITS[name][step]).alias(name) for name in parts]))

    step = F.when(F.length(pack(0)) <= limit, 0).when(F.length(pack(1)) <= limit, 1).when(F.length(pack(2)) <= limit, 2).otherwise(3)
    rows = rows.withColumn("step", step)
    chosen = F.when(F.col("step") == 0, pack(0)).when(F.col("step") == 1, pack(1)).otherwise(pack(2))
    return rows.withColumn("p", chosen).select("source_id", F.when(F.col("step") < 3, F.col("p")).alias("pack"), "step", F.length("p").cast("long").alias("chars"))
