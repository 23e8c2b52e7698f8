"""Approximate nearest neighbours by a hash-prefix forest.

Every vector has one long hash string (``BITS`` random hyperplanes) in each of ``TREES``
trees, and a tree is the sorted array of its strings, kept as pages of a written table.
A query descends to its longest match in every tree, then all trees ascend together: the
prefix that candidates must share gets shorter until enough candidates share it in some
tree. All rows under that prefix are scored on their original vectors; none is left out.

Trees hold strings and entry numbers only; vectors are written once and dealt to blocks of
about ``BLOCK_VALUES`` numbers. The pages that a query visits say which blocks hold candidates of it, and
in such a block it is scored against the entries that share its prefix in some tree. A page
or block is held while its queries stream past, so a task's memory doesn't grow with them.

Equal vectors are one entry with their smallest ids (one more than a query wants), so a
vector that a third of all rows repeat costs as much as any other. Vectors that only differ
in length have equal strings; pages split them by entry number. The directory of pages goes
to every task: a page has ``PAGE_ROWS`` strings, so their number grows with the table, up to
``MOST_PAGES`` (64 MB of directory, 3e10 vectors); beyond that pages grow, 16 bytes a string.

How many candidates are enough, summed over the trees, is ``SHARE`` times the number of
entries and at least ``LEAST``. Vectors without any structure, such as Gaussian noise, need
a large share for a recall of 0.9; clustered ones need far less, and the share is a
parameter.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, take no part; vectors of another length are no
candidates of a query; rows that repeat both id and vector are one row; an id with
several vectors is never its own neighbour; a query without candidates has no rows; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._common import small_batches, stored

TREES, BITS = 8, 48
SHARE, LEAST = 1.1, 4096
PAGE_ROWS, MOST_PAGES = 131072, 2**21
BLOCK_VALUES = 2**20
EVERY, NEAREST = 50, 5
SALTS = 16


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, vec): the rows that take part, each once; vec keeps its components' type."""
    vec = F.col(column)
    if dict(vectors.dtypes)[column] not in ("array<float>", "array<double>"):
        vec = vec.cast("array<double>")
    fine = "id is not null and vec is not null and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(vec, x -> x <> 0)"
    return vectors.select(F.col(id_column).cast("long").alias("id"), vec.alias("vec")).filter(fine)


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """(vec, ids): distinct vectors with their ``keep`` smallest ids, ascending."""
    rank = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))
    near = rows.withColumn("k", rank).filter(F.col("k") <= keep)
    return near.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def planes(dimension: int) -> np.ndarray:
    return np.random.default_rng(7919 + dimension).standard_normal((dimension, TREES * BITS))


def hash_strings(vec: np.ndarray) -> np.ndarray:
    """[rows, TREES] strings of BITS bits as integers; neighbours in a tree are neighbours in order."""
    bits = (vec @ planes(vec.shape[1]) > 0).reshape(len(vec), TREES, BITS)
    return bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def with_hashes(rows: DataFrame, *carried: str) -> DataFrame:
    """Carried columns, vec and hashes (array of TREES strings)."""
    names = [*carried, "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column(len(carried)).to_pylist()
            out: list = [None] * len(vecs)
            for size in {len(v) for v in vecs}:
                at = [i for i, v in enumerate(vecs) if len(v) == size]
                for i, h in zip(at, hash_strings(np.array([vecs[i] for i in at])).tolist(), strict=True):
                    out[i] = h
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], [*names, "hashes"])

    kinds = dict(rows.dtypes)
    return small_batches(rows.select(*names)).mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", hashes array<long>")


def in_trees(rows: DataFrame, *carried: str) -> DataFrame:
    """A row for each tree: tree (numbered apart for each dimension), string ``h`` and the carried columns."""
    out = rows.select(*carried, F.size("vec").alias("_d"), F.posexplode("hashes").alias("_t", "h"))
    return out.select(*carried, (F.col("_d") * TREES + F.col("_t")).cast("long").alias("tree"), "h")


class Directory:
    """Where each tree's pages begin and how many strings they have."""

    def __init__(self, rows: pa.Table):
        self.trees: dict[int, tuple] = {}
        for tree, own in rows.to_pandas().sort_values(["tree", "low", "high", "page"]).groupby("tree"):
            n = own["n"].to_numpy()
            self.trees[int(tree)] = (own["page"].to_numpy(), own["low"].to_numpy(), own["high"].to_numpy(), n, np.concatenate([[0], np.cumsum(n)]))

    def home(self, tree: int, h: np.ndarray) -> np.ndarray:
        page, low, *_ = self.trees[tree]
        return page[np.maximum(np.searchsorted(low, h, side="right") - 1, 0)]

    def span(self, tree: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-last position, in tree order, of the pages that meet [low, high]."""
        _, lows, highs, *_ = self.trees[tree]
        return np.searchsorted(highs, low, side="left"), np.searchsorted(lows, high, side="right")

    def within(self, tree: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the pages that lie in [low, high] as a whole."""
        _, lows, highs, *_ = self.trees[tree]
        return np.searchsorted(lows, low, side="left"), np.searchsorted(highs, high, side="right")


def prefix_range(h: np.ndarray, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    rest = np.int64(BITS) - np.asarray(length, np.int64)
    low = (h >> rest) << rest
    return low, low + ((np.int64(1) << rest) - 1)


#: Takes the held rows of a key and gives what answers batches of its asking rows.
Answer = Callable[[pa.Table], Callable[[pa.RecordBatch], pa.RecordBatch | None]]


def beside(held: DataFrame, asking: DataFrame, keys: list[str], answer: Answer, schema: str) -> DataFrame:
    """What ``answer`` makes of the asking rows of each key, which stream past its held rows."""
    both = held.withColumn("_asks", F.lit(0)).unionByName(asking.withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    both = both.select(*keys, "_asks", *[c for c in both.columns if c not in (*keys, "_asks")])
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stock, ask = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            marks = [c.to_numpy(zero_copy_only=False) for c in b.columns[: width + 1]]
            turns = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for start, end in zip([0, *turns.tolist()], [*turns.tolist(), b.num_rows], strict=True):
                key = tuple(int(m[start]) for m in marks[:width])
                if key != current:
                    current, stock, ask = key, [], None
                part = b.slice(start, end - start)
                if not marks[width][start]:
                    stock.append(part)
                elif stock:
                    ask = ask or answer(pa.Table.from_batches(stock))
                    out = ask(part)
                    if out is not None and out.num_rows:
                        yield out

    return small_batches(both.repartition(*keys).sortWithinPartitions(*keys, "_asks")).mapInArrow(run, schema)


def nearest(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score) of rows(id, vec) for queries(id, vec) among them."""
    keep = nearest + 1
    rows = stored(with_hashes(entries(vectors, keep), "ids").withColumn("eid", F.monotonically_increasing_id()), "ann-entries")
    count, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    block = F.pmod(F.xxhash64("eid"), F.lit(max(1, -(-count * longest // BLOCK_VALUES))))
    index = in_trees(rows, "eid")
    pages = int(min(MOST_PAGES, max(TREES, -(-count * TREES // PAGE_ROWS))))
    index = index.repartitionByRange(pages, "tree", "h", "eid").sortWithinPartitions("tree", "h", "eid").withColumn("page", F.spark_partition_id().cast("long"))
    index = stored(index, "ann-index")
    ends = index.groupBy("tree", "page").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("n")).toArrow()
    directory = Directory(ends)
    wanted = max(least, int(share * count))

    asked = with_hashes(queries.groupBy("vec").agg(F.min("id").alias("q")).repartition("q"), "q")
    asked = stored(asked, "ann-queries").repartition("q")
    pages_of = index.select("tree", "page", "h", block.alias("block"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).to_pandas()
            for tree, own in t.groupby("tree"):
                if tree in directory.trees:
                    page = directory.home(int(tree), own["h"].to_numpy())
                    yield pa.RecordBatch.from_pandas(own.assign(page=page)[["q", "tree", "h", "page"]], preserve_index=False)

    homes = in_trees(asked, "q").select("q", "tree", "h").mapInArrow(route, "q long, tree long, h long, page long").withColumnRenamed("h", "own")

    def descend(page: pa.Table) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        """How many strings at least share each prefix with a query: exactly in its page, by whole pages beyond."""
        tree, number = page["tree"][0].as_py(), page["page"][0].as_py()
        here = np.sort(page["h"].to_numpy())
        numbers, _, _, sizes, before = directory.trees[tree]
        place = int(np.flatnonzero(numbers == number)[0])

        def ask(b: pa.RecordBatch) -> pa.RecordBatch:
            h = b.column("own").to_numpy()
            counts = np.empty((len(h), BITS + 1), np.int64)
            for length in range(BITS + 1):
                low, high = prefix_range(h, length)
                n = np.searchsorted(here, high, side="right") - np.searchsorted(here, low, side="left")
                first, last = directory.within(tree, low, high)
                own_too = (first <= place) & (place < last)
                counts[:, length] = n + np.where(first < last, before[np.maximum(last, first)] - before[first], 0) - np.where(own_too, sizes[place], 0)
            lists = pa.ListArray.from_arrays(np.arange(len(h) + 1, dtype=np.int32) * (BITS + 1), pa.array(counts.ravel()))
            return pa.RecordBatch.from_arrays([b.column("q"), lists], ["q", "counts"])

        return ask

    shared = beside(pages_of.select("tree", "page", "h"), homes, ["tree", "page"], descend, "q long, counts array<long>")
    total = F.transform(F.sequence(F.lit(0), F.lit(BITS)), lambda k: F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.get(x, k)))
    enough = f"aggregate(sequence(0, {BITS}), 0, (a, k) -> if(get(n, k) >= {wanted}, greatest(a, k), a))"
    depth = shared.groupBy("q").agg(F.collect_list("counts").alias("c")).select("q", total.alias("n")).select("q", F.expr(enough).alias("length"))
    asked = stored(asked.join(depth, "q"), "ann-depths").repartition("q")

    def ascend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            t = pa.Table.from_batches([b]).to_pandas()
            for tree, own in t.groupby("tree"):
                if tree in directory.trees:
                    low, high = prefix_range(own["h"].to_numpy(), own["length"].to_numpy())
                    first, last = directory.span(int(tree), low, high)
                    n = np.maximum(last - first, 0)
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
                    for column, values in zip(out, (np.repeat(own["q"].to_numpy(), n), np.full(n.sum(), tree), directory.trees[int(tree)][0][at], np.repeat(low, n), np.repeat(high, n)), strict=True):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["q", "tree", "page", "low", "high"])

    visits = in_trees(asked, "q", "length").select("q", "length", "tree", "h").mapInArrow(ascend, "q long, tree long, page long, low long, high long")

    def blocks_met(page: pa.Table) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        """The blocks with entries between a query's bounds."""
        order = np.argsort(page["h"].to_numpy(), kind="stable")
        h, block = page["h"].to_numpy()[order], page["block"].to_numpy()[order]

        def ask(b: pa.RecordBatch) -> pa.RecordBatch:
            a, z = np.searchsorted(h, b.column("low").to_numpy(), side="left"), np.searchsorted(h, b.column("high").to_numpy(), side="right")
            met = [np.unique(block[x:y]) for x, y in zip(a, z, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("q").to_numpy(), [len(m) for m in met])), pa.array(np.concatenate(met))], ["q", "block"])

        return ask

    met = beside(pages_of, visits, ["tree", "page"], blocks_met, "q long, block long").distinct()

    def score(block: pa.Table) -> Callable[[pa.RecordBatch], pa.RecordBatch | None]:
        """The best entries of a block for each query, among those that share its prefix in some tree."""
        ids, vecs = block["ids"].to_pylist(), block["vec"].combine_chunks()
        first = np.array([x[0] for x in ids])
        strings = block["hashes"].combine_chunks().flatten().to_numpy().reshape(-1, TREES)
        values, start = vecs.values.to_numpy(), vecs.offsets.to_numpy()
        size, groups = np.diff(start), {}
        for d in np.unique(size).tolist():
            at = np.flatnonzero(size == d)
            vec = values[start[at][:, None] + np.arange(d)].astype(np.float64)
            groups[d] = (at, vec, np.sqrt((vec * vec).sum(axis=1)), strings[at])

        def best(q: int, v: list, own: list, length: int) -> Iterator[tuple]:
            at, vec, norm, hashes = groups[len(v)]
            rest = np.int64(BITS - length)
            near = np.flatnonzero(((hashes >> rest) == (np.array(own, np.int64) >> rest)).any(axis=1))
            if not len(near):
                return
            v = np.asarray(v, np.float64)
            rough = (vec[near] @ v) / norm[near]
            if len(near) > keep:  # what is near the cut is measured exactly
                cut = np.partition(rough, len(rough) - keep)[len(rough) - keep]
                near = near[rough >= cut - 1e-9 * abs(cut)]
            s = (vec[near] * v).sum(axis=1) / (norm[near] * np.sqrt((v * v).sum()))
            for k in np.lexsort([first[at][near], -s])[:keep].tolist():
                yield q, int(first[at[near[k]]]), float(s[k]), ids[at[near[k]]]

        def ask(b: pa.RecordBatch) -> pa.RecordBatch | None:
            columns = [b.column(c).to_pylist() for c in ("q", "vec", "hashes", "length")]
            found = [x for q, v, own, length in zip(*columns, strict=True) if len(v) in groups for x in best(q, v, own, length)]
            if not found:
                return None
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())), strict=True)], ["q", "first", "score", "ids"])

        return ask

    placed = rows.select(block.alias("block"), "vec", "ids", "hashes")
    asking = met.join(asked, "q").select("block", "q", "vec", "hashes", "length")
    best = beside(placed, asking, ["block"], score, "q long, first long, score double, ids array<long>")
    best = best.groupBy("q", "first").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first"))
    best = best.withColumn("k", place).filter(F.col("k") <= keep).select("q", "score", F.explode("ids").alias("vec_id"))
    names = queries.groupBy("vec", "id").count().select("vec", F.col("id").alias("query_id"))
    names = names.join(asked.select("vec", "q"), "vec").select("q", "query_id", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).alias("salt"))
    salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    pairs = salted.join(names, ["q", "salt"]).filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def self_join(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """The neighbours of every row whose id is divisible by ``every``, among all rows."""
    rows = usable(vectors)
    return nearest(rows, rows.filter(F.col("id") % every == 0))
