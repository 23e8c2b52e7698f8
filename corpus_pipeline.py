"""A corpus, from documents to packed batches: STAGES in order, each written before the next.

Every stage works on all rows that the one before kept and returns the columns of
documents, except the last, which returns where each document goes. A stage's own
scratch tables are gone once the next begins, as its result is written by then.

Defined results for odd rows are those of the operators; rows are told apart by numbers of
their own, so ids may be null or repeated; documents without words are never drawn by the
mix, and a document whose lines were all dropped has an empty text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import linededup, mixing, neardup, packing, toxicity
from quire.llm._common import documents
from quire.session import table
from quire.tables import keep_stage, scratch, stage_scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL can't express boosted trees.
ORACLE_SQL = None

NEAR_WORDS, NEAR_PERCENT = 5, 80


def stage(work: Stage) -> Stage:
    """work with scratch tables of its own."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_scratch(spark):
            return work(spark, docs, sf_dir)

    return run


@stage
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model doesn't reject."""
    model = toxicity.fit(docs, toxicity.train_labels(table(spark, sf_dir, "labels")))
    return toxicity.scored(docs, model).filter(F.col("_score") < toxicity.THRESHOLD).drop("_score")


@stage
def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the lines that stay."""
    out = linededup.dedup(docs).drop(*linededup.DROP_COLUMNS)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


@stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return neardup.deduplicated(docs, NEAR_WORDS, NEAR_PERCENT)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole time, in the order of the mix's slots."""
    return mixing.in_order(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: its bucket, batch and place."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_common_lines),
    ("near_duplicates", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; all but the last are written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    base = f"{scratch(spark)}/stages-{uuid.uuid4().hex}"
    for name, work in STAGES[:-1]:
        work(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    out = STAGES[-1][1](spark, docs, sf_dir)
    keep_stage()
    return out
