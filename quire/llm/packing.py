"""Packing into optimal length buckets.

The global histogram of lengths goes through a dynamic program whose result is the
``buckets`` boundaries with the least padding; inside a bucket, documents in shuffled
order form batches of at most ``budget`` padded tokens.

The histogram is what reaches the driver: a row for each length that occurs, at most
sqrt(2 * all words) of them, as k different lengths have k * k / 2 words at least: 200,000
for 20 billion words, 5.5 million (130 MB) for 100 TB in the worst case. The program is
exact: its costs are of Monge's kind, so each layer's best cuts ascend and divide and
conquer finds them in n log n.

Rows that are alike (same id and length) are counted where they lie and take consecutive
ranks, so an id that a third of all rows share is as many rows as there are partitions;
ranks inside a bucket come from running totals over hash chunks, so no task holds a bucket.

Defined results: a null or empty text has length 0 and goes to the first bucket; a
document longer than the budget is a batch of its own; fewer distinct lengths than
buckets give fewer buckets; among boundaries with equal padding the smaller wins;
repeated rows take places of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._common import stored, word_count

BUCKETS = 8
TOKEN_BUDGET = 65536


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, pick, part): words of each text, its place in the shuffle, where the row lies."""
    pick = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", word_count(F.col("text")).alias("n_tokens"), pick.alias("pick"), F.spark_partition_id().alias("part"))


def histogram(lens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(lengths that occur, ascending; number of documents of each)."""
    rows = lens.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow()
    length, count = rows["n_tokens"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(length)
    return length[order], count[order]


def boundaries(length: np.ndarray, count: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The bucket lengths with the least padding, ascending, at most ``buckets`` of them."""
    n = len(length)
    if n == 0:
        return []
    length = np.asarray(length, np.int64)
    docs, tokens = (np.concatenate([[0], np.cumsum(x)]).astype(np.int64) for x in (count, count * length))
    best = np.full(n + 1, np.iinfo(np.int64).max // 4, dtype=np.int64)
    best[0] = 0
    steps = []
    for k in range(1, min(buckets, n) + 1):
        best, came = layer(best, length, docs, tokens, k)
        steps.append(came)
    found, j = [], n
    for came in reversed(steps):
        found.append(int(length[j - 1]))
        j = int(came[j])
    return found[::-1]


def layer(before: np.ndarray, length: np.ndarray, docs: np.ndarray, tokens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(least padding of the first j lengths in k buckets, the smallest best start of the last one) for every j.

    All middles of a level are solved at once; what they find bounds the next level's cuts.
    """
    n = len(length)
    least, came = np.full(n + 1, np.iinfo(np.int64).max // 4, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    jobs = [np.array([x], np.int64) for x in (k, n, k - 1, n - 1)]
    while len(jobs[0]):
        first, last, low, high = jobs
        j = (first + last) // 2
        width = np.minimum(high, j - 1) - low + 1
        start = np.concatenate([[0], np.cumsum(width)[:-1]])
        job = np.repeat(np.arange(len(j)), width)
        i = np.arange(len(job)) - start[job] + low[job]
        cost = before[i] + length[j[job] - 1] * (docs[j[job]] - docs[i]) - (tokens[j[job]] - tokens[i])
        least[j] = np.minimum.reduceat(cost, start)
        hits = np.flatnonzero(cost == least[j][job])
        came[j] = i[hits[np.searchsorted(job[hits], np.arange(len(j)))]]
        left, right = first < j, j < last
        jobs = [np.concatenate([a[left], b[right]]) for a, b in ((first, j + 1), (j - 1, last), (low, came[j]), (came[j], high))]
    return least, came


def packed(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch, place: every document's bucket and batch."""
    lens = stored(lengths(docs), "pack-lengths")
    edges = boundaries(*histogram(lens), buckets) or [0]
    which, width = F.lit(len(edges) - 1), F.lit(edges[-1])
    for k in range(len(edges) - 2, -1, -1):
        which = F.when(F.col("n_tokens") <= edges[k], k).otherwise(which)
        width = F.when(F.col("n_tokens") <= edges[k], edges[k]).otherwise(width)
    alike = lens.groupBy("pick", "doc_id", "n_tokens", "part").agg(F.count("*").alias("rows"))
    alike = alike.select("*", which.alias("bucket"), width.cast("long").alias("bucket_len"), F.substring("pick", 1, 3).alias("chunk"))
    chunks = alike.groupBy("bucket", "chunk").agg(F.sum("rows").alias("n"))
    earlier = Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("bucket", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    here = Window.partitionBy("bucket", "chunk").orderBy("pick", "doc_id", "n_tokens", "part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = alike.withColumn("k", F.coalesce(F.sum("rows").over(here), F.lit(0))).join(chunks, ["bucket", "chunk"])
    first = F.col("k") + F.col("base")
    ranked = ranked.withColumn("rank", F.explode(F.sequence(first, first + F.col("rows") - 1)))
    holds = F.expr(f"greatest(1, {budget} div greatest(bucket_len, 1))")
    ranked = ranked.withColumn("holds", holds)
    return ranked.select("doc_id", "n_tokens", "bucket", "bucket_len", F.expr("rank div holds").alias("batch"), F.expr("rank % holds").alias("place"))


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
                  md5(coalesce(doc_id::VARCHAR, '')) AS pick FROM documents),
h AS (SELECT n_tokens AS m, count(*)::BIGINT AS c FROM d GROUP BY n_tokens),
bins AS (SELECT row_number() OVER (ORDER BY m) AS j, m, sum(c) OVER (ORDER BY m)::BIGINT AS docs, sum(c * m) OVER (ORDER BY m)::BIGINT AS toks FROM h),
dp AS (
  SELECT 1 AS k, j, m * docs - toks AS cost, [m] AS edges FROM bins
  UNION ALL
  (SELECT p.k + 1, b.j, min(p.cost + b.m * (b.docs - q.docs) - (b.toks - q.toks)),
          list_append(arg_min(p.edges, struct_pack(c := p.cost + b.m * (b.docs - q.docs) - (b.toks - q.toks), i := p.j)), any_value(b.m))
   FROM dp p JOIN bins q ON q.j = p.j JOIN bins b ON b.j > p.j
   WHERE p.k < {BUCKETS} GROUP BY p.k, b.j)
),
best AS (SELECT edges FROM dp WHERE j = (SELECT max(j) FROM bins) ORDER BY k DESC LIMIT 1),
edge AS (SELECT unnest(generate_series(1, len(edges))) - 1 AS bucket, unnest(edges) AS bucket_len FROM best),
r AS (SELECT d.*, e.bucket, e.bucket_len, row_number() OVER (PARTITION BY e.bucket ORDER BY pick, doc_id, n_tokens) - 1 AS rank
      FROM d JOIN edge e ON e.bucket_len = (SELECT min(x.bucket_len) FROM edge x WHERE x.bucket_len >= d.n_tokens))
SELECT doc_id, n_tokens, bucket::INTEGER AS bucket, bucket_len,
       rank // greatest(1, {TOKEN_BUDGET} // greatest(bucket_len, 1)) AS batch, rank % greatest(1, {TOKEN_BUDGET} // greatest(bucket_len, 1)) AS place
FROM r
"""
