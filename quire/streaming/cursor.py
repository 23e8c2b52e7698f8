"""Job events as a stream: each job's events told once and in order, silent ones passed over."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.session import ship, table
from quire.tables import scratch

TOLD = "job_id long, event_id long, event_type string"


def told(events: DataFrame, silent: tuple[str, ...] = ("view",)) -> DataFrame:
    """Events(event_id, user_id, event_type) past their job's cursor that are told.

    The state is one number for each job, the last event it was told or passed over, and
    never expires: an event that comes again, however late, isn't told again, and a job that
    was silent for years goes on where it was.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cursor = state.get[0] if state.exists else -(2**63)
        new = pd.concat(list(batches)).drop_duplicates("event_id").sort_values("event_id")
        new = new[new["event_id"] > cursor]
        if len(new):
            state.update((int(new["event_id"].iloc[-1]),))
        yield new[~new["event_type"].isin(silent)][["job_id", "event_id", "event_type"]]

    ship(events.sparkSession)
    rows = events.select(F.col("user_id").alias("job_id"), "event_id", "event_type")
    return rows.groupBy("job_id").applyInPandasWithState(advance, TOLD, "cursor long", "append", GroupStateTimeout.NoTimeout)


def drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new stream over the events table has told once all of it has been read: events and the last of each job."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    where = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    writer = told(stream).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}/out").groupBy("job_id").agg(F.count("*").alias("events"), F.max("event_id").alias("last_event"))
