"""Connected components by contraction, for link tables of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._common import stored


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root): nodes of one component have the same root, one of them.

    Each round every node joins the neighbour (or itself) of the smallest hash, hashed anew
    each round, and the graph of what they joined goes on; the number of nodes falls
    geometrically, so the rounds grow with its logarithm. Hubs are pre-aggregated.
    """
    maps = []
    left = stored(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    while not left.isEmpty():
        salt = F.lit(len(maps))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c, salt).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        near = both.groupBy("a").agg(F.min(order("b")).alias("near"))
        joined = stored(near.select(F.col("a").alias("node"), F.least(order("a"), F.col("near"))["v"].alias("root")), "joined")
        maps.append(joined)
        first, second = joined.toDF("a", "ra"), joined.toDF("b", "rb")
        moved = left.join(first, "a").join(second, "b").filter("ra <> rb")
        left = stored(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def through(later: DataFrame, earlier: DataFrame) -> DataFrame:
        next_ = later.toDF("root", "_next")
        return earlier.join(next_, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))

    return stored(reduce(through, reversed(maps)), "components")
