"""Incremental, reversible line dedup: sharded cuckoo filters backed by exact reference counts.

State, all of it tables in the shared folder:

* postings (hi, lo, doc_id, th): a row for each key of each document, the keys of a document
  once; th is a hash of its text, so that documents of one id stay apart;
* counts (hi, lo, n, top): the exact reference count of a key and its largest holder;
* filters (shard, filter): per shard a cuckoo filter of the keys that enough documents
  hold. Fingerprints can be taken out again, so a deletion costs as little as an insertion.

Postings and counts are levels: a batch adds a level of its own and reads the others, but
rewrites nothing. A level of an insertion adds to the counts below; one of a deletion sets
its keys anew, counted from the postings that are left, and a table of the deleted ids takes
their older postings out. Past ``LEVELS`` levels all are merged into one.

A batch is asked against the filters first; only keys that a filter may hold go to the
exact counts, which decide. A filter that overflows is built anew from the counts, and all
are built anew for twice the shards once there are twice as many keys as they were made for:
filters save work and never change a result.

Keys are 128-bit BLAKE2b digests of normalised lines. Counting is pre-aggregated by key
and shards see each key once, so a line that a third of all documents share is one row
there; a document's text only ever meets the keys of its own lines.

Defined results: null or empty text is one empty line, which is never dropped; every row
is a document of its own and rows that repeat a doc_id hold their lines under the same
id, so all of them keep a line of which that id is the largest; a null doc_id is smaller
than any other, can be deleted like any other, and lines that only null ids hold stay; other columns are kept by
``dedup`` and may have any name but those of DROP_COLUMNS; an empty table gives an empty
table. Deleting documents takes out every row of the ids given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm._common import small_batches, stored
from quire.session import ship

LEAST_CHARS, LEAST_DOCS = 20, 3
KEYS_PER_SHARD = 32768
SLOTS, MAX_KICKS = 4, 500
LEVELS = 8
#: As many hot keys may go to every task (24 MB); more of them meet the postings by salted key.
BROADCAST_KEYS, SALTS = 1_000_000, 16


def line_key(line: bytes, least_chars: int = LEAST_CHARS) -> bytes | None:
    """The digest of a line's key, or None for keys that are too short to be dropped."""
    key = line.strip().lower()
    if len(key) < least_chars or (not key.isascii() and len(key.decode()) < least_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key is in one of two buckets."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.85)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    def places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of keys given as signed 64-bit halves."""
        print_ = ((lo.astype(np.int64).view(np.uint64) >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = hi.astype(np.int64).view(np.uint64) & self.mask
        return print_, first.astype(np.int64), (first ^ self.turn(print_)).astype(np.int64)

    def turn(self, print_: np.ndarray) -> np.ndarray:
        return (print_.astype(np.uint64) * np.uint64(0x5BD1E995)) & self.mask

    def holds(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        print_, a, b = self.places(hi, lo)
        return (self.table[a] == print_[:, None]).any(axis=1) | (self.table[b] == print_[:, None]).any(axis=1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False if a key found no place; the filter is then of no more use."""
        table, seed = self.table, 12345
        for print_, a, b in zip(*(x.tolist() for x in self.places(hi, lo)), strict=True):
            at = next((x for x in (a, b) if (table[x] == 0).any()), None)
            for _ in range(MAX_KICKS if at is None else 0):
                at = b if at is None else at
                seed = (seed * 1103515245 + 12345) & 0x7FFFFFFF
                slot = (seed >> 16) % SLOTS
                print_, table[at, slot] = int(table[at, slot]), print_
                at ^= int(self.turn(np.array([print_], np.uint16))[0])
                if (table[at] == 0).any():
                    break
            free = np.flatnonzero(table[at] == 0)
            if not len(free):
                return False
            table[at, free[0]] = print_
        return True

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Takes out keys that are known to be in."""
        for print_, a, b in zip(*(x.tolist() for x in self.places(hi, lo)), strict=True):
            for x in (a, b):
                found = np.flatnonzero(self.table[x] == print_)
                if len(found):
                    self.table[x, found[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())


def postings_of(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(hi, lo, doc_id, th): the distinct keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, keys = [], [], []
            for doc, text, th in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = {line_key(x, least_chars) for x in (text or "").encode().split(b"\n")} - {None}
                keys += own
                ids += [doc] * len(own)
                hashes += [th] * len(own)
            halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64())], ["hi", "lo", "doc_id", "th"])

    return small_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("th"))).mapInArrow(run, "hi long, lo long, doc_id long, th long")


def same_id(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """rows semi- or anti-joined with ids(doc_id), where null is an id too."""
    return rows.join(ids.select(F.col("doc_id").alias("_id")), F.expr("doc_id <=> _id"), how)


class LineIndex:
    """The state above for one corpus; insert() and delete() change it, decide() asks it."""

    def __init__(self, spark, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS):
        ship(spark)
        self.spark, self.least_chars, self.least_docs = spark, least_chars, least_docs
        self._version = 0
        self._postings: list[tuple[int, DataFrame]] = []
        self._gone: list[tuple[int, DataFrame]] = []
        self._counts: list[tuple[int, DataFrame]] = []
        self.filters = None
        self.shards, self._keys = 1, 0

    @property
    def postings(self) -> DataFrame:
        """The postings of the documents that are in."""
        levels = []
        for version, rows in self._postings:
            later = [ids for v, ids in self._gone if v > version]
            levels.append(same_id(rows, reduce(DataFrame.unionByName, later).distinct(), "left_anti") if later else rows)
        return reduce(DataFrame.unionByName, levels)

    @property
    def counts(self) -> DataFrame:
        """(hi, lo, n, top) of every key that some document holds."""
        return self.counted().filter("n > 0")

    def counted(self, keys: DataFrame | None = None) -> DataFrame:
        """(hi, lo, n, top), of some keys(hi, lo) or all: each level's, or the last that sets a key anew and those above it."""
        of = lambda rows: rows if keys is None else rows.join(keys, ["hi", "lo"], "left_semi")
        if len(self._counts) == 1:
            return of(self._counts[0][1]).select("hi", "lo", "n", "top")
        rows = reduce(DataFrame.unionByName, [of(rows).withColumn("v", F.lit(v)) for v, rows in self._counts])
        listed = rows.groupBy("hi", "lo").agg(F.collect_list(F.struct("v", "anew", "n", "top")).alias("x"))
        listed = listed.withColumn("since", F.expr("coalesce(array_max(transform(filter(x, y -> y.anew), y -> y.v)), 0)")).withColumn("x", F.expr("filter(x, y -> y.v >= since)"))
        return listed.select("hi", "lo", F.expr("aggregate(x, cast(0 as bigint), (a, y) -> a + y.n)").alias("n"), F.expr("array_max(transform(x, y -> y.top))").alias("top"))

    def _hot(self, counts: DataFrame) -> DataFrame:
        return counts.filter(F.col("n") >= self.least_docs)

    def _shard(self, keys: DataFrame) -> DataFrame:
        """By bits of hi that a filter doesn't use for its buckets."""
        return keys.withColumn("shard", F.pmod(F.shiftrightunsigned("hi", 40), F.lit(self.shards)))

    def insert(self, docs: DataFrame) -> DataFrame:
        """Takes documents in; returns their postings."""
        self._version += 1
        new = stored(postings_of(docs, self.least_chars), "line-postings")
        delta = new.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"), F.lit(False).alias("anew"))
        delta = stored(delta, "line-counts")
        self._postings.append((self._version, new))
        if not self._counts:
            self._counts.append((self._version, delta))
            self._keys = delta.count()
            self._build()
            return new
        was = self.counted(delta.select("hi", "lo")).withColumnRenamed("n", "was").drop("top")
        both = delta.join(was, ["hi", "lo"], "left").withColumn("was", F.coalesce("was", F.lit(0)))
        hot = both.filter((F.col("was") < self.least_docs) & (F.col("was") + F.col("n") >= self.least_docs))
        moved = stored(hot.select("hi", "lo", F.lit(True).alias("put")), "line-moves")
        self._counts.append((self._version, delta))
        self._keys += delta.count()
        self._move(moved)
        return new

    def delete(self, doc_ids: DataFrame) -> None:
        """Takes the documents with these ids out; doc_ids has a column doc_id."""
        self._version += 1
        ids = stored(doc_ids.select("doc_id").distinct(), "line-deleted")
        touched = stored(same_id(self.postings, ids, "left_semi").select("hi", "lo").distinct(), "line-touched")
        self._gone.append((self._version, ids))
        left = self.postings.join(touched, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        again = touched.join(left, ["hi", "lo"], "left").select("hi", "lo", F.coalesce("n", F.lit(0)).alias("n"), "top", F.lit(True).alias("anew"))
        again = stored(again, "line-counts")
        was = self.counted(touched).filter(F.col("n") >= self.least_docs).select("hi", "lo")
        moved = stored(again.filter(F.col("n") < self.least_docs).join(was, ["hi", "lo"]).select("hi", "lo", F.lit(False).alias("put")), "line-moves")
        self._counts.append((self._version, again))
        self._move(moved)

    def _move(self, moved: DataFrame) -> None:
        """Puts keys(hi, lo, put) that became common into the filters or takes out those no longer so; keeps levels few, filters whole and shards of their size."""
        if len(self._counts) > LEVELS:
            merged = stored(self.counts.withColumn("anew", F.lit(False)), "line-counts")
            left = stored(self.postings, "line-postings")
            self._counts, self._postings, self._gone = [(self._version, merged)], [(self._version, left)], []
            self._keys = merged.count()
        if self._keys > 2 * KEYS_PER_SHARD * self.shards:
            self._build()
            return

        def change(key: tuple, filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            raw = filters["filter"].iloc[0] if len(filters) else CuckooFilter.sized(2 * len(keys)).to_bytes()
            f = CuckooFilter.from_bytes(raw)
            gone, come = keys[~keys["put"].astype(bool)], keys[keys["put"].astype(bool)]
            f.remove(gone["hi"].to_numpy(), gone["lo"].to_numpy())
            raw = f.to_bytes() if f.insert(come["hi"].to_numpy(), come["lo"].to_numpy()) else None
            return pd.DataFrame({"shard": [key[0]], "filter": [raw]})

        changed = self.filters.groupBy("shard").cogroup(self._shard(moved).groupBy("shard")).applyInPandas(change, "shard long, filter binary")
        changed = stored(changed, "line-filters")
        full = changed.filter("filter is null").select("shard")
        if not full.isEmpty():
            again = self._built(self._shard(self._hot(self.counted()).select("hi", "lo")).join(full, "shard", "left_semi"))
            changed = stored(changed.filter("filter is not null").unionByName(again), "line-filters")
        self.filters = changed

    def _build(self) -> None:
        """All filters, for as many shards as the keys need."""
        self.shards = max(1, -(-self._keys // KEYS_PER_SHARD))
        self.filters = stored(self._built(self._shard(self._hot(self.counted()).select("hi", "lo"))), "line-filters")

    @staticmethod
    def _built(keys: DataFrame) -> DataFrame:
        def build(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
            room = 2 * len(keys)
            f = CuckooFilter.sized(room)
            while not f.insert(keys["hi"].to_numpy(), keys["lo"].to_numpy()):
                room *= 2
                f = CuckooFilter.sized(room)
            return pd.DataFrame({"shard": [key[0]], "filter": [f.to_bytes()]})

        return keys.groupBy("shard").applyInPandas(build, "shard long, filter binary")

    def maybe(self, keys: DataFrame) -> DataFrame:
        """Those of distinct keys (hi, lo) that their shard's filter may hold."""

        def ask(filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            if not len(filters) or not len(keys):
                return keys.head(0)[["hi", "lo"]]
            f = CuckooFilter.from_bytes(filters["filter"].iloc[0])
            return keys.loc[f.holds(keys["hi"].to_numpy(), keys["lo"].to_numpy()), ["hi", "lo"]]

        asked = self._shard(keys.select("hi", "lo")).groupBy("shard")
        return self.filters.groupBy("shard").cogroup(asked).applyInPandas(ask, "hi long, lo long")

    def decide(self, postings: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        """(doc_id, th, _drop): for each document that loses lines, the keys it loses."""
        keys = postings.select("hi", "lo").distinct() if keys is None else keys
        common = stored(self._hot(self.counted(self.maybe(keys))).filter("top is not null").select("hi", "lo", "top"), "line-common")
        if common.count() <= BROADCAST_KEYS:
            lost = postings.join(F.broadcast(common), ["hi", "lo"])
        else:
            salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            lost = postings.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS))).join(salted, ["hi", "lo", "salt"])
        lost = lost.filter("doc_id < top or doc_id is null")
        return lost.groupBy("doc_id", "th").agg(F.collect_set(F.struct("hi", "lo")).alias("_drop"))


DROP_COLUMNS = ("_n_lines", "_n_dropped")


def without_lines(docs: DataFrame, drops: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs with the text that stays, and DROP_COLUMNS: lines before dropping, lines dropped."""
    names = docs.columns
    drops = drops.select(F.col("doc_id").alias("_drop_id"), F.col("th").alias("_drop_th"), "_drop")
    rows = docs.join(drops, docs["doc_id"].eqNullSafe(drops["_drop_id"]) & (F.xxhash64(docs["text"]) == drops["_drop_th"]), "left").select(*[docs[c] for c in names], "_drop")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, drop in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                n = (text or "").count("\n") + 1
                if drop:
                    gone = {np.array([d["hi"], d["lo"]], "<i8").tobytes() for d in drop}
                    stay = [x for x in text.encode().split(b"\n") if line_key(x, least_chars) not in gone]
                    kept.append(b"\n".join(stay).decode())
                    n_dropped.append(n - len(stay))
                else:
                    kept.append(text or "")
                    n_dropped.append(0)
                n_lines.append(n)
            arrays = [pa.array(kept, pa.string()) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, *DROP_COLUMNS])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in DROP_COLUMNS)])
    return small_batches(rows).mapInArrow(run, schema)


def dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs without the lines that enough documents hold, but for their largest holder."""
    index = LineIndex(docs.sparkSession, least_chars, least_docs)
    postings = index.insert(docs)
    return without_lines(docs, index.decide(postings, index.counts), least_chars)


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 for every document."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (SELECT rowid_ AS r, doc_id, u.i, u.line, translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(ls) AS line, unnest(range(len(ls))) AS i) u),
h AS (SELECT k, count(DISTINCT r) AS n, max(doc_id) AS top FROM l WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT r) >= {LEAST_DOCS}),
m AS (SELECT l.*, h.k IS NOT NULL AND (l.doc_id < h.top OR (l.doc_id IS NULL AND h.top IS NOT NULL)) AS gone FROM l LEFT JOIN h ON l.k = h.k)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
