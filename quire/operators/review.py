"""Reading and reviewing: searches, paged views, evidence for proposed changes, receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text


def grep(blocks: DataFrame, needle: str, most_chars: int = 400) -> DataFrame:
    """Blocks whose text has the needle, blanks and digit widths aside, with the number of hits of their source."""
    wanted = text.search_key(F.lit(needle))
    found = blocks.filter(~F.col("type").isin(*text.NOISE_TYPES)).filter(text.search_key("text").contains(wanted))
    total = F.count("*").over(Window.partitionBy("source_id"))
    return found.select("source_id", "gid", "type", F.substring("text", 1, most_chars).alias("text"), F.length("text").cast("long").alias("full_len"), total.alias("total"))


def list_blocks(blocks: DataFrame, needle: str, offset: int = 0, limit: int = 80, most_chars: int = 220) -> DataFrame:
    """A page of each source's blocks whose text has the needle as it stands, letter case aside."""
    found = blocks.filter(F.lower("text").contains(needle.lower()))
    k = F.row_number().over(Window.partitionBy("source_id").orderBy("gid")) - 1
    page = found.withColumn("_k", k).filter((F.col("_k") >= offset) & (F.col("_k") < offset + max(1, min(400, limit))))
    return page.select("source_id", "gid", "type", F.substring("text", 1, most_chars).alias("text"))


def text_page(blocks: DataFrame, offset: int, size: int = 6000) -> DataFrame:
    """A page of each block's text and where the next one starts, null at the end."""
    n = F.length("text")
    return blocks.select("source_id", "gid", F.substring("text", offset + 1, size).alias("text"), F.when(n > offset + size, F.lit(offset + size)).cast("long").alias("next_offset"))


def receipt_problems(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files(source_id, relative, role, sha256) against a receipt(source_id, relative, stored_sha256): what is missing, unknown or changed.

    An index may be rewritten on the way, so its digest doesn't count.
    """
    both = expected.join(actual, ["source_id", "relative"], "full")
    changed = (F.col("role") != "index") & (F.col("sha256") != F.col("stored_sha256"))
    problem = F.when(F.col("stored_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(changed, "changed")
    return both.select("source_id", "relative", problem.alias("problem")).filter("problem is not null")


def page_support(proposed: DataFrame, seen: DataFrame) -> DataFrame:
    """proposed(source_id, shard_ord, page_idx, printed) with the evidence for it among seen(source_id, shard_ord, page_idx, printed).

    The number itself on the page, or the neighbour's one less or more, or both neighbours.
    """
    at = seen.select("source_id", "shard_ord", "page_idx", (F.col("printed") - F.col("page_idx")).alias("offset")).distinct()
    p = proposed.withColumn("offset", F.col("printed") - F.col("page_idx"))
    spread = at.select("source_id", "shard_ord", "offset", F.explode(F.array(F.struct((F.col("page_idx")).alias("page_idx"), F.lit(0).alias("d")), F.struct((F.col("page_idx") + 1).alias("page_idx"), F.lit(-1).alias("d")), F.struct((F.col("page_idx") - 1).alias("page_idx"), F.lit(1).alias("d")))).alias("x"))
    near = spread.select("source_id", "shard_ord", "offset", "x.page_idx", "x.d").groupBy("source_id", "shard_ord", "page_idx", "offset").agg(F.bool_or(F.col("d") == 0).alias("same"), F.bool_or(F.col("d") == -1).alias("before"), F.bool_or(F.col("d") == 1).alias("behind"))
    rows = p.join(near, ["source_id", "shard_ord", "page_idx", "offset"], "left")
    how = F.when(F.col("same"), "page").when(F.col("before") & F.col("behind"), "both").when(F.col("before"), "previous").when(F.col("behind"), "next").otherwise("none")
    return rows.select("source_id", "shard_ord", "page_idx", "printed", how.alias("support"))


def undelivered(events: DataFrame, cursors: DataFrame, silent: tuple[str, ...] = ()) -> DataFrame:
    """Events(job_id, event_seq, stage) past their job's cursor(job_id, cursor); silent stages are not told."""
    rows = events.join(cursors, "job_id", "left").filter(F.col("event_seq") > F.coalesce("cursor", F.lit(0)))
    return rows.filter(~F.col("stage").isin(*silent) if silent else F.lit(True)).select("job_id", "event_seq", "stage")
