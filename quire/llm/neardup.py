"""Near duplicates by a chosen-path set-similarity join.

A document's set is its distinct word shingles. Equal sets are one *set row* from the
start. Each of ``TREES`` independent trees branches the set rows by chosen minwise values:
at the root by ``ROOT_COORDS`` coordinates of a minhash signature, below by one or
sometimes two (1 / threshold on average) that the node chooses. Nodes of at most
``SMALL_NODE`` rows are compared exhaustively on 64-value sketches. A larger node most of
whose rows resemble its first one, or one at ``DEPTH``, becomes one candidate group as it
is; the others branch on.

Sketches only say which sets must meet: candidates with an estimate within 4.2 standard
deviations of the threshold are joined into groups, and inside each group all pairs of
different clusters are compared on the full sets, exactly. A group is searched breadth
first, so a set that is linked to its cluster is never compared with it again and a
tight group of n sets costs n comparisons, not n squared.

A group of more than ``GROUP`` sets or ``GROUP_VALUES`` shingles is dealt to blocks. First
every block is searched together with the group's pivot, its smallest set. What that links
to the pivot needs no comparison among itself any more; the rest is then searched against
it, and against itself, in pairs of blocks. So no group has to fit in one task, no pair is
left out, and the text of a member of a tight group is sent once.

A pair at the threshold misses a tree with probability (1 - t) ** ROOT_COORDS at the
root, so four trees miss it with less than 1e-5 in small nodes. In a larger one that isn't
tight it has to survive the branching: where all eight of its root values are as frequent as
that (texts made mostly of passages that hundreds of others share), about 0.4 % of pairs at
85 % and 1.3 % at 80 % are missed, by calculation; more ``TREES`` or ``ROOT_COORDS`` miss fewer.

Defined results: texts that are null, empty or without words have empty sets and are
linked with nothing; a text of fewer words than a shingle has its whole sequence as its
only shingle; rows without doc_id are never linked and are kept; rows that repeat a
doc_id stand for themselves, each with the component of its own text; other columns are
ignored, or carried by ``deduplicated``, whatever their names; an empty table gives an
empty table.

Sets are told apart by 128 bits of digest; rows by numbers given when they are first
written, since ids may repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._common import numbered, small_batches, stored
from quire.llm.graph import components

TREES, ROOT_COORDS, DEPTH, SMALL_NODE, TIGHT = 4, 2, 6, 256, 0.9
GROUP, GROUP_VALUES = 4096, 4_000_000
COORDS = 64
_rng = np.random.default_rng(20240229)
FLIP = _rng.integers(0, 2**64, COORDS, dtype=np.uint64)
TIMES = _rng.integers(0, 2**64, COORDS, dtype=np.uint64) | np.uint64(1)
STEP = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out + h[k : len(h) - width + 1 + k] * STEP[k % len(STEP)])
    return np.unique(out)


def signature(values: np.ndarray) -> np.ndarray:
    """The COORDS minwise values of a set that isn't empty."""
    least = np.full(COORDS, np.iinfo(np.uint64).max)
    for a in range(0, len(values), 2048):
        part = (values[a : a + 2048, None] ^ FLIP) * TIMES
        least = np.minimum(least, part.min(axis=0))
    return least


def set_rows(docs: DataFrame, row: str, words: int) -> DataFrame:
    """(row, doc_id, n, sid, roots, sketch) for every document; sid, roots and sketch are null for empty sets.

    roots are the minwise values that the trees' roots branch by; sketch has 16 bits of each
    value of another reading of the signature.
    """
    need = TREES * ROOT_COORDS
    names = ["row", "doc_id", "n", "sid", "roots", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sid, roots, sketch = [], [], [], []
            for text in b.column(2).to_pylist():
                values = shingle_set(text, words)
                n.append(len(values))
                if len(values):
                    mins = signature(values)
                    sid.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                    roots.append(mins[:need].astype(np.int64).tolist())
                    sketch.append(mixed(mins).astype(np.uint16).tobytes())
                else:
                    sid.append(None), roots.append(None), sketch.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sid, pa.binary()), pa.array(roots, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names)

    return small_batches(docs.select(row, "doc_id", "text")).mapInArrow(run, "row long, doc_id long, n long, sid binary, roots array<long>, sketch binary")


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys != keys[-1])
        cut = int(change[-1]) + 1 if len(change) else 0  # the last group may go on
        if cut or (held and held[-1].column(0)[0].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def groups_in(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def sketch_links(sketches: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """A forest of the pairs whose estimated similarity reaches ``least``."""
    todo = list(range(len(sketches)))
    while todo:
        queue = [todo.pop()]
        while queue and todo:
            at = queue.pop()
            rest = np.array(todo)
            near = (sketches[rest] == sketches[at]).mean(axis=1) >= least
            for other in rest[near].tolist():
                yield at, other
            queue += rest[near].tolist()
            todo = rest[~near].tolist()


def node_links(rows: DataFrame, least: float) -> DataFrame:
    """(a, b) candidate links inside small nodes; rows(key, sid, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches):
            keys, sids = t.column(0).to_numpy(), t.column(1).combine_chunks()
            sketches = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint16).reshape(-1, COORDS)
            a, b = [], []
            for start, end in groups_in(keys):
                if end - start == 2:
                    if (sketches[start] == sketches[start + 1]).mean() >= least:
                        a.append(start), b.append(start + 1)
                    continue
                for x, y in sketch_links(sketches[start:end], least):
                    a.append(start + x), b.append(start + y)
            if a:
                yield pa.RecordBatch.from_arrays([sids.take(pa.array(a)), sids.take(pa.array(b))], ["a", "b"])

    return rows.select("key", "sid", "sketch").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a binary, b binary")


def agreement(one: str, other: str) -> str:
    """SQL for the estimated similarity of two sketches."""
    same = f"filter(sequence(0, {COORDS - 1}), i -> substring({one}, 2 * i + 1, 2) = substring({other}, 2 * i + 1, 2))"
    return f"size({same}) / {COORDS}"


def candidate_links(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the trees' candidate links between set rows(sid, roots, sketch)."""
    least = threshold - 4.2 * float(np.sqrt(threshold * (1 - threshold) / COORDS))
    coords = [F.xxhash64(F.lit(k // ROOT_COORDS), F.lit(k), F.col("roots")[k]) for k in range(TREES * ROOT_COORDS)]
    rows = sets.select("sid", F.explode(F.array(*coords)).alias("key"))
    found = None
    for level in range(1, DEPTH + 1):
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("sid").alias("b")).filter("size > 1")
        met = rows.join(sizes, "key")
        if "sketch" not in met.columns:
            met = met.join(sets.select("sid", "sketch"), "sid")
        met = stored(met, "node-rows")
        links = node_links(met.filter(F.col("size") <= SMALL_NODE), least)
        found = links if found is None else found.unionByName(links)
        large = met.filter(F.col("size") > SMALL_NODE)
        if large.isEmpty():
            return found
        pivots = sets.select(F.col("sid").alias("b"), F.col("sketch").alias("pivot"))
        near = F.expr(agreement("sketch", "pivot")) >= least
        large = stored(large.join(pivots, "b").withColumn("near", near).select("key", "sid", "b", "sketch", "near"), "large-nodes")
        tight = F.avg(F.col("near").cast("int")) >= (0 if level == DEPTH else TIGHT)
        nodes = stored(large.groupBy("key").agg(tight.alias("tight")), "large-keys")
        close, loose = nodes.filter("tight").select("key"), nodes.filter("not tight").select("key")
        found = found.unionByName(large.filter("near").select(F.col("sid").alias("a"), "b"))
        found = found.unionByName(large.filter("not near").join(close, "key", "left_semi").select(F.col("sid").alias("a"), "b"))
        large = large.join(loose, "key", "left_semi")
        if loose.isEmpty():
            return found
        one = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(COORDS))
        more = F.pmod(F.xxhash64("key", F.lit(level), F.lit(1)), F.lit(COORDS))
        twice = F.pmod(F.xxhash64("key", F.lit(level), F.lit(2)), F.lit(1000)) < round(1000 * (1 / threshold - 1))
        at = F.explode(F.when(twice, F.array_distinct(F.array(one, more))).otherwise(F.array(one)))
        child = large.select("key", "sid", "sketch", at.alias("at"))
        value = F.expr("substring(sketch, cast(2 * at + 1 as int), 2)")
        rows = child.select(F.xxhash64("key", "at", value).alias("key"), "sid", "sketch")
    return found


def exact_links(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """A forest of the links between sets; every pair of different clusters is compared."""
    flat = np.concatenate(sets)
    values, flat = np.unique(flat, return_inverse=True)
    size = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    mark = np.zeros(len(values), np.int32)
    todo = np.arange(len(sets))
    while len(todo):
        queue, todo = [int(todo[0])], todo[1:]
        while queue and len(todo):
            at = queue.pop()
            own = flat[start[at] : start[at] + size[at]]
            mark[own] = 1
            fits = todo[(100 * np.minimum(size[todo], size[at]) >= percent * np.maximum(size[todo], size[at]))]
            if len(fits):
                if len(fits) == len(sets) - 1:
                    both = np.add.reduceat(mark[flat], start)[fits]
                else:
                    both = np.array([mark[flat[start[x] : start[x] + size[x]]].sum() for x in fits])
                linked = fits[100 * both >= percent * (size[fits] + size[at] - both)]
                for other in linked.tolist():
                    yield at, other
                queue += linked.tolist()
                todo = np.setdiff1d(todo, linked, assume_unique=True)
            mark[own] = 0


def group_links(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): confirmed links, as a forest, inside groups; rows(key, sid, text)."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingle_set(t, words).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["key", "sid", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches):
            keys, sids = t.column(0).to_numpy(), t.column(1).combine_chunks()
            found = []
            for start, end in groups_in(keys):
                sets = [np.frombuffer(v, np.uint64) for v in t.column(2).slice(start, end - start).to_pylist()]
                found += ((start + x, start + y) for x, y in exact_links(sets, percent))
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([sids.take(pa.array(a)), sids.take(pa.array(b))], ["a", "b"])

    ready = small_batches(rows.select("key", "sid", "text")).mapInArrow(sets_of, "key long, sid binary, values binary")
    return ready.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a binary, b binary")


def dealt(members: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first round, members of large groups): where each of members(sid, row, n, group) is searched.

    Members of groups that aren't large(group, pivot, blocks) meet in their group; those of
    large ones in their block, to which the pivot goes too.
    """
    own = F.pmod(F.xxhash64("sid", F.lit(7)), F.col("blocks"))
    joined = members.join(large, "group", "left")
    small = joined.filter("blocks is null").select("sid", "row", F.xxhash64("group").alias("key"))
    rest = joined.filter("blocks is not null")
    first = rest.withColumn("key", F.xxhash64("group", own))
    pivots = rest.filter("sid = pivot").withColumn("key", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.xxhash64("group", k))))
    both = first.select("sid", "row", "key").unionByName(pivots.select("sid", "row", "key")).distinct()
    return small.unionByName(both), rest


def second_round(rest: DataFrame, linked: DataFrame) -> DataFrame:
    """(sid, row, key): the pairs of blocks in which members of large groups meet again.

    linked(node, root) are the components of the first round. Members that are with their
    group's pivot (the core) meet the others only; the others meet everything.
    """
    root = linked.select(F.col("node").alias("sid"), "root")
    rows = rest.join(root, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    core = rows.filter("sid = pivot").select("group", F.col("root").alias("core_root"))
    rows = rows.join(core, "group").withColumn("core", F.col("root") == F.col("core_root"))
    half = lambda name, c: F.greatest(F.ceil(F.count_if(c) * 2 / GROUP), F.ceil(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) * 2 / GROUP_VALUES)).alias(name)
    sizes = rows.groupBy("group").agg(half("core_blocks", F.col("core")), half("other_blocks", ~F.col("core"))).filter("other_blocks > 0")
    rows = rows.select("group", "sid", "row", "core").join(sizes, "group")
    own = F.pmod(F.xxhash64("sid", F.lit(8)), F.when(F.col("core"), F.col("core_blocks")).otherwise(F.col("other_blocks")))
    others = F.sequence(F.lit(0).cast("long"), F.col("other_blocks") - 1)
    cores = F.when(F.col("core_blocks") > 0, F.sequence(F.lit(0).cast("long"), F.col("core_blocks") - 1)).otherwise(F.array().cast("array<bigint>"))
    as_core = F.transform(others, lambda k: F.xxhash64(F.lit("core"), "group", own, k))
    as_other = F.concat(F.transform(cores, lambda k: F.xxhash64(F.lit("core"), "group", k, own)), F.transform(others, lambda k: F.xxhash64(F.lit("other"), "group", F.least(own, k), F.greatest(own, k))))
    return rows.select("sid", "row", F.explode(F.when(F.col("core"), as_core).otherwise(as_other)).alias("key"))


def rows_with_components(docs: DataFrame, row: str, words: int, percent: int) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, best) for the rows of a numbered table; best is true for one row of each component.

    That row is the one with the component's smallest doc_id.
    """
    rows = stored(set_rows(docs, row, words), "set-rows")
    usable = rows.filter("sid is not null and doc_id is not null")
    sets = usable.groupBy("sid").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("n").alias("n"), F.first("roots").alias("roots"), F.first("sketch").alias("sketch"))
    sets = stored(sets, "sets")
    groups = components(candidate_links(sets, percent / 100))
    members = groups.join(sets.select("sid", F.col("first.row").alias("row"), "n"), groups["node"] == sets["sid"]).select("sid", "row", "n", F.col("root").alias("group"))
    members = stored(members, "members")
    blocks = F.greatest(F.ceil(F.count("*") * 2 / GROUP), F.ceil(F.sum("n") * 2 / GROUP_VALUES))
    large = members.groupBy("group").agg(F.min("sid").alias("pivot"), F.count("*").alias("size"), F.sum("n").alias("values"), blocks.alias("blocks"))
    large = stored(large.filter((F.col("size") > GROUP) | ((F.col("size") > 2) & (F.col("values") > GROUP_VALUES))).select("group", "pivot", "blocks"), "large-groups")
    placed, rest = dealt(members, large)
    texts = docs.select(F.col(row).alias("row"), "text")
    links = group_links(texts.join(placed.hint("merge"), "row"), words, percent)
    if not large.isEmpty():
        links = stored(links, "first-links")
        again = second_round(rest, components(links))
        links = links.unionByName(group_links(texts.join(again.hint("merge"), "row"), words, percent))
    links = components(links)
    roots = sets.select("sid", "first").join(links.toDF("sid", "root"), "sid", "left").select("sid", "first", F.coalesce("root", "sid").alias("root"))
    least = roots.groupBy("root").agg(F.min("first").alias("least"))
    found = roots.join(least, "root").select("sid", "least")
    out = rows.select("row", "doc_id", F.col("n").alias("n_shingles"), "sid").join(found, "sid", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("least.doc_id", "doc_id"))
    best = F.col("doc_id").isNull() | F.col("least").isNull() | (F.col("row") == F.col("least.row"))
    return out.select("row", "doc_id", "n_shingles", component.alias("component_id"), best.alias("best"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document.

    Documents are linked if their sets' intersection is at least ``percent`` hundredths of
    their union.
    """
    rows, row = numbered(docs.select("doc_id", "text"), "near-rows")
    out = rows_with_components(rows, row, words, percent)
    return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates, that of the smallest doc_id; all columns stay."""
    rows, row = numbered(docs, "near-rows")
    kept = rows_with_components(rows, row, words, percent).filter("best").select(F.col("row").alias(row))
    return rows.join(kept.hint("merge"), row).select(docs.columns)
