"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled by a digest of their id and laid end to end, once
for each of at most ``MAX_EPOCHS`` epochs, then cut into blocks of equally many words.
Slot i of the schedule is the golden-ratio point frac(i * 0.618...), taken through the
sources' cumulative target shares; the r-th slot of a source takes the source's r-th
block. A source whose slots run out before its target gets its last blocks at the end,
so what is taken equals the target to the nearest word.

A document's place in the mix are the slots whose blocks hold words of it: ``first_slot``
and how many, ``n_slots``; ``in_order`` gives the documents themselves, each as often as it
is taken, in the order of their slots.

Everything is a DataFrame expression. No window spans more than a hash chunk of a source,
so a source with a third of all rows is spread like any other; running totals over chunks
give the offsets. Rows that are alike (same source, id and size) lie together as one row
for each partition they come from, so an id that many rows share is spread too. Only the
table of sources, a row for each, is worked through in one task: thousands of sources, or
a million, not a billion.

Defined results: a null text has size 0 and is never taken (first_slot null, n_slots 0);
null sources form one source,
ordered last; rows that repeat a doc_id are documents of their own with the same place in
the shuffle; an empty table gives an empty table; columns other than doc_id, source and
text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._common import numbered, stored, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 256
#: The golden ratio's fraction as a step on 32 bits: every residue comes once in 2**32 slots.
GOLDEN_STEP, PERIOD = 2654435769, 4294967296
SLOT_CHUNK = 65536
SHARE_BINS = 1024


def sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(rid, doc_id, source, size, pick, chunk, part): a row for each document, with its place in the shuffle and where it lies.

    rid is the row's number: the column ``row``, or a new one.
    """
    pick = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rid = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(rid.alias("rid"), "doc_id", "source", word_count(F.col("text")).alias("size"), pick.alias("pick"))
    return rows.select("*", F.substring("pick", 1, 3).alias("chunk"), F.shiftright("rid", 33).alias("part"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(idx, source, source_size, target, need, low, high): a row for each source.

    Shares of the total by weight; what goes beyond MAX_EPOCHS times a source's size is
    reshared among the others. With sources ordered by cap / weight, the common level is
    the largest of (total - caps before) / (weights from here on).
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "idx")
    per = per.withColumn("idx", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * MAX_EPOCHS).withColumn("total", F.sum("source_size").over(everything))
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    still = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - before).cast("double") / still)
    per = per.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(everything)))
    per = per.withColumn("need", F.least(F.col("cap"), F.floor(F.col("target") + 0.5).cast("long")))
    running = Window.orderBy("idx")
    whole = F.greatest(F.sum("need").over(everything), F.lit(1))
    per = per.withColumn("high", F.sum("need").over(running) / whole)
    per = per.withColumn("low", F.coalesce(F.lag("high").over(running), F.lit(0.0)))
    return per.select("idx", "source", "source_size", "target", "need", "low", "high")


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, idx, rank): the source of each slot and the block of that source it takes."""
    spark = targets.sparkSession
    blocks = F.ceil(F.col("need") / block_words).cast("long")
    wanted = targets.filter("need > 0").select("idx", "low", "high", blocks.alias("blocks"))
    n = wanted.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    u = F.col("slot") % PERIOD * GOLDEN_STEP % PERIOD / PERIOD
    points = spark.range(n).select(F.col("id").alias("slot"), u.alias("u")).withColumn("bin", F.floor(F.col("u") * SHARE_BINS))
    last = F.least(F.floor(F.col("high") * SHARE_BINS), F.lit(SHARE_BINS - 1))
    shares = wanted.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") * SHARE_BINS), last)))
    drawn = points.join(shares, "bin").filter("u >= low and u < high")
    drawn = drawn.select("slot", "idx", "blocks", F.floor(F.col("slot") / SLOT_CHUNK).alias("part"))
    parts = drawn.groupBy("idx", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("idx").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("idx", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    here = Window.partitionBy("idx", "part").orderBy("slot")
    ranked = drawn.withColumn("k", F.row_number().over(here) - 1).join(parts, ["idx", "part"])
    ranked = ranked.select("slot", "idx", (F.col("k") + F.col("base")).alias("rank"), "blocks").filter("rank < blocks").drop("blocks")
    got = drawn.groupBy("idx").agg(F.count("*").alias("got"))
    late = wanted.join(got, "idx", "left").select("idx", F.explode(F.expr("if(coalesce(got, 0) < blocks, sequence(coalesce(got, 0), blocks - 1), array())")).alias("rank"))
    return ranked.unionByName(late.select((F.lit(n) + F.col("rank")).alias("slot"), "idx", "rank"))


def placed(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """sized with its source's row of targets and ``at``, the words of its source before it."""
    alike = sized.groupBy("source", "chunk", "pick", "doc_id", "size", "part").agg(F.sort_array(F.collect_list("rid")).alias("rids"))
    words = F.col("size") * F.size("rids")
    chunks = alike.groupBy("source", "chunk").agg(F.sum(words).alias("words"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    chunks = chunks.withColumnRenamed("source", "s").join(targets.drop("low", "high"), F.expr("s <=> source")).drop("s")
    chunks = chunks.withColumnRenamed("chunk", "c").withColumnRenamed("source", "s")
    here = Window.partitionBy("source", "chunk").orderBy("pick", "doc_id", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("before", F.coalesce(F.sum(words).over(here), F.lit(0)))
    rows = alike.join(chunks, F.expr("s <=> source and c = chunk")).drop("s", "c")
    rows = rows.select("*", F.posexplode("rids").alias("k", "rid")).drop("rids")
    return rows.withColumn("at", F.col("base") + F.col("before") + F.col("k") * F.col("size")).drop("base", "before", "k")


def pieces(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(rid, idx, rank, epoch, size, words): each document's part in each block its source needs."""
    last = F.least(F.lit(MAX_EPOCHS - 1), F.floor((F.col("need") - 1 - F.col("at")) / F.col("source_size")))
    cut = rows.filter("size > 0 and at < need").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    cut = cut.withColumn("start", F.col("at") + F.col("epoch") * F.col("source_size"))
    cut = cut.withColumn("end", F.least(F.col("start") + F.col("size"), F.col("need")))
    cut = cut.withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))))
    words = F.least(F.col("end"), (F.col("rank") + 1) * block_words) - F.greatest(F.col("start"), F.col("rank") * block_words)
    return cut.select("rid", "idx", "rank", "epoch", "size", words.alias("words"))


def mixture(sized: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents, mix): placed documents, and the mix's pieces in slots (slot, rid, epoch, size, words)."""
    sized = stored(sized, "mix-sizes")
    targets = stored(source_targets(sized), "mix-targets")
    rows = placed(sized, targets)
    mix = pieces(rows, block_words).join(schedule(targets, block_words), ["idx", "rank"]).select("slot", "rid", "epoch", "size", "words")
    return rows, mix


def mixed_sizes(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot and n_slots for every document."""
    rows, mix = mixture(sizes(docs), block_words)
    taken = mix.groupBy("rid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(taken, "rid", "left").select("doc_id", "size", "source_size", "target", none("taken"), "first_slot", none("n_slots"))


def in_order(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents of the mix in the order of its slots, with all their columns.

    A document comes once for each epoch in which the mix takes half of it or more, at the
    slot in which it begins there; files and the rows in them follow the slots.
    """
    rows, row = numbered(docs, "mix-rows")
    _, mix = mixture(sizes(rows, row), block_words)
    drawn = mix.groupBy("rid", "epoch", "size").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    drawn = drawn.filter("2 * words >= size").select(F.col("rid").alias(row), "slot")
    slot = next(c for c in ("_slot", "_slot_", "_slot__") if c not in rows.columns)
    out = rows.join(drawn.withColumnRenamed("slot", slot).hint("merge"), row)
    return out.repartitionByRange(slot, row).sortWithinPartitions(slot, row).select(docs.columns)


SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS pick FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM d GROUP BY source),
w AS (SELECT *, CASE idx % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap,
             sum(source_size) OVER ()::BIGINT AS total FROM per),
lv AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(weight) OVER (ORDER BY cap / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
t AS (SELECT *, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM lv),
n AS (SELECT *, least(cap, floor(target + 0.5)::BIGINT) AS need FROM t),
nh AS (SELECT *, ceil(need / {BLOCK_WORDS})::BIGINT AS blocks, (sum(need) OVER (ORDER BY idx))::DOUBLE / greatest(1, sum(need) OVER ())::DOUBLE AS high FROM n),
sh AS (SELECT *, coalesce(lag(high) OVER (ORDER BY idx), 0.0) AS low, (sum(blocks) OVER ())::BIGINT AS slots FROM nh),
points AS (SELECT slot, ((slot % {PERIOD}) * {GOLDEN_STEP} % {PERIOD})::DOUBLE / {PERIOD}::DOUBLE AS u FROM (SELECT unnest(range((SELECT max(slots) FROM sh))) AS slot)),
drawn AS (SELECT idx, slot, row_number() OVER (PARTITION BY idx ORDER BY slot) - 1 AS rank, blocks FROM points JOIN sh ON need > 0 AND u >= low AND u < high),
got AS (SELECT idx, count(*) AS got FROM drawn GROUP BY 1),
slots AS (SELECT idx, slot, rank FROM drawn WHERE rank < blocks
  UNION ALL SELECT sh.idx, slots + r.r, r.r FROM sh LEFT JOIN got USING (idx), LATERAL (SELECT unnest(range(coalesce(got, 0), blocks)) AS r) r WHERE need > 0),
a AS (SELECT d.*, (sum(size) OVER (PARTITION BY source ORDER BY pick, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS at_word FROM d),
e AS (SELECT a.doc_id, a.size, sh.source_size, sh.target, sh.idx, at_word,
  [struct_pack(a := at_word + k * sh.source_size, z := least(at_word + k * sh.source_size + a.size, need)) for k in range(3) if a.size > 0 AND at_word + k * sh.source_size < need] AS parts
  FROM a JOIN sh ON a.source IS NOT DISTINCT FROM sh.source)
SELECT doc_id, size, source_size, target, coalesce(list_sum([p.z - p.a for p in parts]), 0)::BIGINT AS taken, s.slot AS first_slot,
  coalesce(list_sum([(p.z - 1) // {BLOCK_WORDS} - p.a // {BLOCK_WORDS} + 1 for p in parts]), 0)::BIGINT AS n_slots
FROM e LEFT JOIN slots s ON s.idx = e.idx AND len(parts) > 0 AND s.rank = at_word // {BLOCK_WORDS}
"""
