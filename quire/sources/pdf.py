"""Page counts of PDF files, as far as they can be read without a PDF library.

The number is the largest count of a page tree's node, in plain objects or in compressed
object streams; a file without one counts its page objects. Encrypted files and other
filters than Flate aren't read: their count is null, and a shard plan leaves them pending.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import ship

STREAM = re.compile(rb"<<([^>]*(?:>(?!>)[^>]*)*)>>\s*stream\r?\n(.*?)endstream", re.S)
TREE = re.compile(rb"<<(?:(?!>>).)*?/Type\s*/Pages\b(?:(?!>>).)*>>", re.S)
COUNT, PAGE = re.compile(rb"/Count\s+(\d+)"), re.compile(rb"/Type\s*/Page(?![a-zA-Z])")


def page_count(content: bytes | None) -> int | None:
    """How many pages a file has; null if that can't be read."""
    if not content or not content.startswith(b"%PDF-") or b"/Encrypt" in content:
        return None
    parts = [STREAM.sub(b"", content)]
    for head, raw in STREAM.findall(content):
        if b"/ObjStm" in head and b"/FlateDecode" in head:
            try:
                parts.append(zlib.decompressobj().decompress(raw))
            except zlib.error:
                return None
    counts = [int(n) for part in parts for node in TREE.findall(part) for n in COUNT.findall(node)]
    pages = sum(len(PAGE.findall(part)) for part in parts)
    return max(counts) if counts else pages or None


def page_counts(files: DataFrame) -> DataFrame:
    """(source_id, n_pages) of files(source_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([page_count(c) for c in b.column(1).to_pylist()], pa.int64())], ["source_id", "n_pages"])

    ship(files.sparkSession)
    return files.select("source_id", "content").mapInArrow(run, "source_id long, n_pages long")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, path, content) of the PDF files under a path that Spark can read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return found.select(F.abs(F.xxhash64("path")).alias("source_id"), "path", "content")
