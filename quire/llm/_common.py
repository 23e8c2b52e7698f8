"""What the operators share: word rules, scratch tables, row numbers, batch sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import ship, table
from quire.tables import forget, shared_dir, stored  # noqa: F401

#: A word is a maximal run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(docs as a stored table with a number for each row, that column's name).

    The number is the row's key from then on, also where ids are null or repeated.
    """
    column = "_row"
    while column in docs.columns:
        column += "_"
    return stored(docs.withColumn(column, F.monotonically_increasing_id()), name), column


def word_count(text) -> F.Column:
    """Number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(df: DataFrame, size: str = "4m") -> DataFrame:
    """df for Arrow workers: the package is sent to them, and batches are bounded in bytes, as texts may be long.

    A bound that the session has set itself stays.
    """
    spark = df.sparkSession
    ship(spark)
    if not spark._jsparkSession.conf().contains(ARROW_BYTES):
        spark.conf.set(ARROW_BYTES, size)
    return df
