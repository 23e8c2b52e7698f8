"""Ordered folds over each source, for rules whose state depends on what came before.

Rows are dealt by source and sorted, and a partition's sources are folded one after the
other from its stream of Arrow batches, so many small sources cost no more than a few
large ones. A fold holds one source at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

Fold = Callable[[int, list[dict]], Iterable[dict]]


def fold_sources(rows: DataFrame, order: tuple[str, ...], fold: Fold, schema: str, key: str = "source_id") -> DataFrame:
    """fold(source, rows in order) of every source; it returns rows without the key."""
    kind = StructType.fromDDL(f"{key} long, {schema}")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[dict] = []

        def flush() -> None:
            if held:
                source = held[0][key]
                out.extend({key: source, **r} for r in fold(source, list(held)))
                held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0][key] != row[key]:
                    flush()
                held.append(row)
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        flush()
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, kind)
