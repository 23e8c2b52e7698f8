"""Tables between stages: written to the folder that driver and executors share, so lineage ends there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only on a single machine, where the session has none, a local one is made.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = made.get() if made.isDefined() else None
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


_scope: ContextVar[str] = ContextVar("quire_scope", default="results")
_last: ContextVar[str | None] = ContextVar("quire_last_scope", default=None)


def scratch(spark: SparkSession) -> str:
    """This application's folder of scratch tables, which goes when the application ends."""
    where = f"{shared_dir(spark)}/quire-scratch/{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_quire_scratch", None) != where:
        fs, path = _path(spark, where)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        spark.sparkContext._quire_scratch = where
    return where


@contextmanager
def stage_scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables of a pipeline's stage: a folder of their own, deleted when the thread's next stage begins.

    By then the stage's result has been written, so nothing reads them any more. Tables of
    other results, threads and applications are not touched.
    """
    if _last.get() is not None:
        _delete(spark, _last.get())
    name = f"stage-{uuid.uuid4().hex}"
    _last.set(f"{scratch(spark)}/{name}")
    before = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(before)


def keep_stage() -> None:
    """Leaves the scratch tables of the thread's last stage until the application ends, as its result may not have been read yet."""
    _last.set(None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{_scope.get()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._quire_path)


def _path(spark: SparkSession, where: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _delete(spark: SparkSession, where: str) -> None:
    fs, path = _path(spark, where)
    fs.delete(path, True)
