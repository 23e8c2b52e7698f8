"""The overlay of human corrections: tidy tables that always win over what was inferred.

Levels, deletions, additions and anchors are tables keyed by source and node key; applying
them is joins, changing them is an anti join and a union, and a plan of changes is checked
as a whole before any of it is applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import col, strip
from quire.operators import outline

LEAST_LEVEL, MOST_LEVEL = 1, 9
#: The actions of a plan and the fields they must have.
ACTIONS = {
    "level": ("key", "level"),
    "levels": ("pairs",),
    "level-clear": ("key",),
    "add": ("gid", "title", "level"),
    "add-clear": ("gid",),
    "delete": ("key", "snapshot"),
    "delete-clear": ("key",),
    "anchor": ("shard", "page_idx", "printed"),
    "anchor-clear": ("shard", "page_idx"),
}


def node_key(c: Column | str) -> Column:
    """A node's key in its one form: whole numbers without leading zeros, other keys stripped; null if empty."""
    s = strip(col(c).cast("string"))
    return F.when(s.rlike(r"^-?[0-9]+\z"), s.try_cast("decimal(38,0)").cast("string")).when(s != "", s)


def upsert(table: DataFrame, changes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """table with rows of changes in place of those with the same keys."""
    return table.join(changes.select(*keys), list(keys), "left_anti").select(*changes.columns).unionByName(changes)


def remove(table: DataFrame, keys_of: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return table.join(keys_of.select(*keys), list(keys), "left_anti").select(*table.columns)


def set_levels(levels: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels after changes(source_id, key, level), refused changes): levels are 1 to 9."""
    fine = F.col("level").between(LEAST_LEVEL, MOST_LEVEL) & node_key("key").isNotNull()
    good = changes.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("key", node_key("key"))
    return upsert(levels, good.filter("fine").drop("fine"), ("source_id", "key")), good.filter("not fine").drop("fine")


def set_deleted(deleted: DataFrame, added: DataFrame, levels: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(deleted, added, levels) after deletions keys(source_id, key): deleting an addition takes it back, with its level."""
    is_added = F.col("key").startswith("add:")
    undone = keys.filter(is_added).withColumn("gid", F.substring("key", 5, 38).cast("long"))
    return upsert(deleted, keys.filter(~is_added), ("source_id", "key")), remove(added, undone, ("source_id", "gid")), remove(levels, undone, ("source_id", "key"))


def reflowed(tree: DataFrame, levels: DataFrame, deleted: DataFrame, added: DataFrame) -> DataFrame:
    """A tree(source_id, seq, key, level, title, marker) rebuilt under an overlay.

    Deleted nodes go (front matter can't), additions(source_id, seq, title, level) come in
    after a node of the same place, given levels are kept as they are, and parents follow
    from levels alone.
    """
    kept = tree.join(deleted.select("source_id", "key", F.lit(True).alias("gone")), ["source_id", "key"], "left").filter("gone is null or marker = 'front'").drop("gone")
    rows = kept.select("source_id", F.col("seq").cast("double").alias("at"), "key", "level", "title", F.lit(False).alias("manual"))
    new = added.select("source_id", (F.col("seq") + 0.5).alias("at"), F.concat(F.lit("add:"), F.col("seq")).alias("key"), "level", "title", F.lit(True).alias("manual"))
    given = levels.select("source_id", "key", F.col("level").alias("given"))
    rows = rows.unionByName(new).join(given, ["source_id", "key"], "left").withColumn("level", F.coalesce("given", "level")).drop("given")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("at", "key")).cast("long")
    return outline.with_parents(rows.withColumn("seq", place))


def edit_view(tree: DataFrame, deleted: DataFrame, added: DataFrame) -> DataFrame:
    """What an editor lists: the nodes that stay, the deleted ones and the additions, in document order."""
    mark = tree.join(deleted.select("source_id", "key", F.lit(True).alias("gone")), ["source_id", "key"], "left")
    rows = mark.select("source_id", "seq", F.lit(0).alias("borrowed"), "key", "title", F.when(F.col("gone"), "deleted").otherwise("kept").alias("state"))
    new = added.select("source_id", "seq", F.lit(1).alias("borrowed"), F.concat(F.lit("add:"), F.col("seq")).alias("key"), "title", F.lit("added").alias("state"))
    both = rows.unionByName(new)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("seq", "borrowed", "key")).cast("long"))


def summary(levels: DataFrame, deleted: DataFrame, added: DataFrame) -> DataFrame:
    """How many corrections of each kind a source has."""
    kinds = [t.select("source_id", F.lit(k).alias("kind")) for k, t in (("levels", levels), ("deleted", deleted), ("added", added))]
    rows = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return rows.groupBy("source_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("levels", "deleted", "added")])


def diff(old: DataFrame, new: DataFrame, real: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, errors) between a tree and its edited copy, both (source_id, key, gid, title, level, marker).

    Missing is deletion (not of front matter); titles of real nodes can't change; a row
    without key or with an unknown one is an addition and needs a real block(source_id, gid),
    a title and a level. Any error refuses the source.
    """
    new = new.withColumn("key", node_key("key"))
    twice = new.filter("key is not null").groupBy("source_id", "key").agg(F.count("*").alias("n")).filter("n > 1").select("source_id", "key", F.lit("duplicate key").alias("error"))
    n = new.filter("key is not null").dropDuplicates(["source_id", "key"]).select("source_id", "key", F.col("title").alias("new_title"), F.col("level").alias("new_level"), F.lit(True).alias("there"))
    o = old.select("source_id", "key", "title", "level", "marker", F.lit(True).alias("had"))
    sources = new.select("source_id").distinct()
    both = o.join(sources, "source_id", "left_semi").join(n, ["source_id", "key"], "full")
    gone = F.col("there").isNull()
    is_added = F.col("key").startswith("add:")
    level = F.coalesce("new_level", "level")
    retitled = (F.coalesce(strip("new_title"), F.lit("")) != "") & (strip("new_title") != F.col("title"))
    error = F.when(gone & (F.col("marker") == "front"), "front matter can't go").when(F.col("had") & (level != F.col("level")) & ~level.between(LEAST_LEVEL, MOST_LEVEL), "level out of range").when(F.col("had") & retitled & ~is_added, "title of a real node")
    action = F.when(gone, "delete").when(F.col("had") & is_added & (retitled | (level != F.col("level"))), "add").when(F.col("had") & (level != F.col("level")), "level")
    rows = both.withColumns({"error": error, "action": action})
    unknown = rows.filter("had is null").select("source_id", "key")
    extra = new.join(unknown, ["source_id", "key"], "left_semi").unionByName(new.filter("key is null")).join(real.select("source_id", "gid", F.lit(True).alias("real")), ["source_id", "gid"], "left")
    complete = F.col("gid").isNotNull() & (F.coalesce(strip("title"), F.lit("")) != "") & F.col("level").isNotNull()
    wrong = F.when(~complete, "incomplete addition").when(~F.col("level").between(LEAST_LEVEL, MOST_LEVEL), "level out of range").when(F.col("real").isNull(), "no such block")
    extra = extra.withColumn("error", wrong)
    changes = rows.filter("had and action is not null and error is null").select("source_id", "action", "key", F.col("level").alias("old_level"), F.when(~gone, level).alias("new_level"))
    changes = changes.unionByName(extra.filter("error is null").select("source_id", F.lit("add").alias("action"), F.concat(F.lit("add:"), F.col("gid")).alias("key"), F.lit(None).cast("long").alias("old_level"), F.col("level").alias("new_level")))
    errors = rows.filter("error is not null").select("source_id", "key", "error").unionByName(twice).unionByName(extra.filter("error is not null").select("source_id", "key", "error"))
    return changes, errors


def mass_deletions(changes: DataFrame, old: DataFrame) -> DataFrame:
    """Sources that lose more than a third of their nodes, and more than three: perhaps a cut-off file."""
    n = old.groupBy("source_id").agg(F.count("*").alias("nodes"))
    d = changes.filter("action = 'delete'").groupBy("source_id").agg(F.count("*").alias("deleted"))
    return d.join(n, "source_id").filter(F.col("deleted") > F.greatest(F.lit(3), F.floor(F.col("nodes") / 3)))


def plan_violations(items: DataFrame) -> DataFrame:
    """What is wrong with the items(source_id, item, action, evidence, fields map<string,string>) of plans.

    Unknown actions, missing fields (0 is a value), no evidence, a snapshot without a title.
    """
    needs = F.create_map(*[x for a, f in ACTIONS.items() for x in (F.lit(a), F.array(*map(F.lit, f)))])
    wanted = F.try_element_at(needs, F.col("action"))
    missing = F.filter(wanted, lambda f: F.coalesce(F.try_element_at(F.col("fields"), f), F.lit("")).isin("", "{}"))
    problems = F.array_compact(F.array(
        F.when(wanted.isNull(), F.lit("unknown action")),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ","))),
        F.when(F.coalesce(strip("evidence"), F.lit("")) == "", F.lit("no evidence")),
        F.when((F.col("action") == "delete") & F.coalesce(F.get_json_object(F.try_element_at(F.col("fields"), F.lit("snapshot")), "$.title"), F.lit("")).isin(""), F.lit("snapshot without title")),
    ))
    return items.select("source_id", "item", F.explode(problems).alias("problem"))


def accepted_plans(items: DataFrame) -> DataFrame:
    """The items of plans without any violation: all of a plan or none."""
    return items.join(plan_violations(items).select("source_id").distinct(), "source_id", "left_anti")
