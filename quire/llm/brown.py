"""Brown class bigrams: exchange clustering of words, class transitions and word emissions.

Texts are encoded once, a *block* of a few million tokens at a time: token numbers of a
block-own dictionary, and the dictionary dealt into *shards* by word. From then on words
meet their counts and classes shard by shard and texts meet their words block by block,
as packed arrays; a word's entry moves once per block, not once per occurrence, and no
table of all words is ever in one place.

Clustering is the exchange algorithm, distributed: a pass counts, for every word, the
classes before and after it in all training texts, and moves it to the class that raises
the likelihood of the class bigrams most, given where all words were. The most frequent
words found the classes; words of at least ``LEAST_COUNT`` occurrences move during the
passes (after the first, half of them at a time, so that neighbours don't swap forever),
all others once at the end.

P(word | before) = (1 - u(a)) * P(class | a) * count(word) / count(class) for known words
and u(a) for an unknown one, where a is the class before and u(a) the share of words seen
once among what follows a; transitions are smoothed towards class frequencies. This sums
to one over the known words, the end and one unknown word.

Words are told apart by 64-bit hashes. Defined results: a null text is the empty text,
which is an end and no words; the checksum of a null doc_id is that of the empty string;
every row gives one row, and repeated rows are read as often as they are there; other
columns are ignored; without training texts everything is unknown and scores stay
finite; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._common import forget, shared_dir, small_batches, stored
from quire.llm.neardup import groups_in, runs_of

CLASSES, PASSES, LEAST_COUNT = 32, 5, 5
BLOCK_TOKENS = 4_000_000
HELD_OUT_OF, HELD_OUT_IS = 10, 0
END_CLASS, RARE_CLASS, UNKNOWN = 0, CLASSES + 1, CLASSES + 2
WIDTH = CLASSES + 3  # end, classes, rare, unknown
if WIDTH > 64:
    raise ValueError("counts around words have six bits for a class")
END_KEY = xxhash.xxh3_64_intdigest(b"\n") - 2**63

ROW = "at long, kind int, other long, a binary, b binary, c binary, d binary, ids array<long>"
NAMES = [x.split()[0] for x in ROW.split(", ")]
TEXTS, WORDS, COUNTS, FOUND, AROUND, CELLS, PLACED, TOP = range(8)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    columns = list(zip(*[(*r, *[None] * (len(kinds) - len(r))) for r in rows], strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], NAMES)


def _pack(values: np.ndarray, kind: type) -> bytes:
    """Numbers as compressed bytes, all first bytes, then all second ones and so on, which compresses better."""
    raw = np.ascontiguousarray(values, kind)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _array(value: bytes | None, kind: type) -> np.ndarray:
    if value is None:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(value), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self) + 1  # 0 is the end
        return found


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(20)) % np.uint64(shards)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT_OF == HELD_OUT_IS


def encoded(docs: DataFrame, shards: int) -> DataFrame:
    """Rows of kind TEXTS (by block) and WORDS (by shard and block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 24
        numbers, parts, lens, train, ids, held = _Numbers(), [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens = np.concatenate(parts)
            keys = np.fromiter((xxhash.xxh3_64_intdigest(w) - 2**63 for w in numbers), np.int64, len(numbers))
            keys = np.concatenate([[END_KEY], keys])
            learn = np.repeat(np.array(train, bool), lens)
            n = np.bincount(tokens[learn], minlength=len(keys)).astype(np.int32)
            yield _rows([(block, TEXTS, 0, _pack(tokens, np.int32), _pack(lens, np.int32), _pack(train, np.uint8), None, ids)])
            shard = shard_of(keys, shards)
            order = np.argsort(shard, kind="stable")
            rows = []
            for start, end in groups_in(shard[order]):
                own = order[start:end]
                rows.append((int(shard[own[0]]), WORDS, block, _pack(keys[own], np.int64), _pack(own, np.int32), _pack(n[own], np.int32)))
            yield _rows(rows)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (text or "").encode().lower().split()
                own = np.zeros(len(words) + 1, np.int32)
                own[:-1] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                parts.append(own), lens.append(len(own)), train.append(not held_out(doc)), ids.append(doc)
                held += len(own)
                if held >= BLOCK_TOKENS:
                    yield from flush()
                    block, numbers, parts, lens, train, ids, held = block + 1, _Numbers(), [], [], [], [], 0
        if ids:
            yield from flush()

    spark = docs.sparkSession
    made = small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, ROW)
    path = f"{shared_dir(spark)}/quire-scratch/encoded-{uuid.uuid4().hex}"
    made.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    columns = [c for c in made.columns if c != "kind"]
    return spark.read.schema(", ".join(x for x in ROW.split(", ") if not x.startswith("kind ")) + ", kind int").parquet(path).select(columns[0], "kind", *columns[1:])


def gathered(*tables: DataFrame, run) -> DataFrame:
    """run() over the rows of all tables that have the same ``at``, in the order of kinds."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches):
            keys = t.column(0).to_numpy()
            for start, end in groups_in(keys):
                part = t.slice(start, end - start)
                yield from run(int(keys[start]), [tuple(r.values()) for r in part.to_pylist()])

    parts = rows.repartition("at").sortWithinPartitions("at", "kind", "other")
    return small_batches(parts).mapInArrow(groups, ROW)


def counted(words: DataFrame) -> DataFrame:
    """Rows of kind COUNTS by shard: sorted keys, training counts, and [sum, distinct] of them."""

    def run(shard: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, inverse = np.unique(np.concatenate([_array(r[3], np.int64) for r in rows]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([_array(r[5], np.int32) for r in rows]), len(keys)).astype(np.int64)
        top = np.lexsort([keys, -n])[:CLASSES]
        yield _rows([(shard, COUNTS, 0, _pack(keys, np.int64), _pack(n, np.int64), None, None, [int(n.sum()), int((n > 0).sum())])])
        yield _rows([(shard, TOP, int(n[k]), None, None, None, None, [int(keys[k])]) for k in top.tolist() if n[k] and keys[k] != END_KEY])

    return stored(gathered(words, run=run), "counts")


def founded(counts: DataFrame, founders: dict[int, int]) -> DataFrame:
    """Rows of kind PLACED by shard: the first classes, of the end and the most frequent words."""

    def run(shard: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = _array(rows[0][3], np.int64)
        placed = np.full(len(keys), RARE_CLASS, np.uint8)
        for key, which in founders.items():
            at = np.searchsorted(keys, key)
            if at < len(keys) and keys[at] == key:
                placed[at] = which
        yield _rows([(shard, PLACED, 0, _pack(placed, np.uint8))])

    return gathered(counts, run=run)


def looked_up(words: DataFrame, counts: DataFrame, placed: DataFrame, least: int, counted: bool) -> DataFrame:
    """Rows of kind FOUND by block: dictionary numbers, places in the shard, counts and classes.

    Only words with at least ``least`` training occurrences (0: all words); counts only if asked for.
    """

    def run(shard: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        known = {r[1]: r for r in rows if r[1] != WORDS}
        keys, n, classes = _array(known[COUNTS][3], np.int64), _array(known[COUNTS][4], np.int64), _array(known[PLACED][3], np.uint8)
        for r in rows:
            if r[1] == WORDS:
                at, number = np.searchsorted(keys, _array(r[3], np.int64)), _array(r[4], np.int32)
                use = n[at] >= least
                at, number = at[use], number[use]
                if len(at):
                    yield _rows([(r[2], FOUND, shard, _pack(number, np.int32), _pack(at, np.int32), _pack(n[at], np.int64) if counted else None, _pack(classes[at], np.uint8))])

    return gathered(words, counts, placed, run=run)


def _block(rows: list[tuple]) -> tuple:
    """Tokens, lengths, training flags and ids of a block, and its FOUND rows."""
    texts = next(r for r in rows if r[1] == TEXTS)
    return _array(texts[3], np.int32), _array(texts[4], np.int32), _array(texts[5], np.uint8).astype(bool), texts[7], [r for r in rows if r[1] == FOUND]


def _classes(tokens: np.ndarray, found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Class and training count of each dictionary number."""
    size = int(tokens.max()) + 1
    classes, n = np.full(size, RARE_CLASS, np.uint8), np.zeros(size, np.int64)
    for r in found:
        number = _array(r[3], np.int32)
        classes[number] = _array(r[6], np.uint8)
        if r[5] is not None:
            n[number] = _array(r[5], np.int64)
    return classes, n


def _before(classes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The class before each token; a text begins after an end."""
    out = np.empty_like(classes)
    out[1:] = classes[:-1]
    out[np.concatenate([[0], np.cumsum(lens)[:-1]])] = END_CLASS
    return out


def around(texts: DataFrame, found: DataFrame, hapax: bool) -> DataFrame:
    """Rows of kind CELLS (class bigrams) and, unless hapax, AROUND by shard (classes around words).

    With hapax, words seen once also count as the unknown word, before and after.
    """

    def run(block: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        tokens, lens, train, _, found = _block(rows)
        classes, n = _classes(tokens, found)
        learn = np.repeat(train, lens)
        own = classes[tokens]
        before = _before(own, lens)
        tokens, own, before = tokens[learn], own[learn], before[learn]
        cells = np.bincount(before.astype(np.int64) * WIDTH + own, minlength=WIDTH * WIDTH)
        if hapax and len(tokens):
            once = n[tokens] == 1
            cells = cells.reshape(WIDTH, WIDTH)
            cells[:, UNKNOWN] += np.bincount(before[once], minlength=WIDTH)
            after = np.concatenate([[False], once[:-1]])
            cells[UNKNOWN] += np.bincount(own[after & (before != END_CLASS)], minlength=WIDTH)
            cells = cells.ravel()
        yield _rows([(int(k), CELLS, int(cells[k])) for k in np.flatnonzero(cells)])
        if hapax or not len(tokens):
            return
        size = len(classes)
        shard, at = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        for r in found:
            number = _array(r[3], np.int32)
            shard[number], at[number] = r[2], _array(r[4], np.int32)
        inner = shard[tokens] >= 0
        inner &= tokens != 0
        wide = np.int32 if size < 2**24 else np.int64
        left = tokens[inner].astype(wide) * wide(128) + before[inner]
        follows = inner[:-1]
        right = tokens[:-1][follows].astype(wide) * wide(128) + (own[1:][follows] + np.uint8(64))
        pair, count = np.unique(np.concatenate([left, right]), return_counts=True)
        number, code = pair >> 7, (pair & 127).astype(np.uint8)
        order = np.lexsort([at[number], shard[number]])
        number, code, count = number[order], code[order], count[order]
        out = [(int(shard[number[s]]), AROUND, block, _pack(np.diff(at[number[s:e]], prepend=0), np.int32), _pack(code[s:e], np.uint8), _pack(count[s:e], np.int32)) for s, e in groups_in(shard[number])] if len(number) else []
        yield _rows(out)

    return gathered(texts, found, run=run)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_classes(word: np.ndarray, code: np.ndarray, n: np.ndarray, size: int, now: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The class for each of ``size`` words that raises the class bigrams' likelihood most.

    word, code, n: sorted by word, how often a class is around it (code: class before, or
    64 + class after). cells: the class bigram counts with all words where they are now.
    """
    best = np.zeros(size, np.int64)
    real = np.arange(1, CLASSES + 1)
    rows, columns, plain = cells.sum(axis=1), cells.sum(axis=0), _f(cells.astype(np.float64))
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    for a in range(0, len(starts), 20000):
        first = starts[a : a + 20000]
        last = starts[a + 20000] if a + 20000 < len(starts) else len(word)
        w, c, m = word[first[0] : last], code[first[0] : last].astype(np.int64), n[first[0] : last].astype(np.float64)
        own, begins = w[first - first[0]], first - first[0]
        after, other = c >= 64, c & 63
        table = np.where(after[:, None], cells[real[None, :], other[:, None]], cells[other[:, None], real[None, :]])
        more = table + m[:, None]
        gain = more * np.log(more) - np.where(after[:, None], plain[real[None, :], other[:, None]], plain[other[:, None], real[None, :]])
        placed = np.flatnonzero((now[w] != RARE_CLASS) & (now[w] != END_CLASS))  # a word in its class is taken out first
        column = now[w[placed]] - 1
        rest = np.maximum(table[placed, column] - m[placed], 0)
        gain[placed, column] = _f(rest + m[placed]) - _f(rest)
        gain = np.add.reduceat(gain, begins, axis=0)
        total = np.add.reduceat(np.where(after, 0, m), begins)[:, None]
        inside = (now[own][:, None] == real[None, :]) * total
        for margin in (rows[real], columns[real]):
            rest = np.maximum(margin[None, :] - inside, 0)
            gain -= _f(rest + total) - _f(rest)
        best[own] = real[gain.argmax(axis=1)]
    return best


def moved(counts: DataFrame, placed: DataFrame, near: DataFrame, cells: np.ndarray, turn: int | None) -> DataFrame:
    """Rows of kind PLACED after an exchange; turn None moves the words without a class only."""

    def run(shard: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = next(_array(r[3], np.int64) for r in rows if r[1] == COUNTS)
        now = next(_array(r[3], np.uint8) for r in rows if r[1] == PLACED).astype(np.int64)
        parts = [r for r in rows if r[1] == AROUND]
        if parts:
            word = np.concatenate([np.cumsum(_array(r[3], np.int32), dtype=np.int64) for r in parts])
            code = np.concatenate([_array(r[4], np.uint8) for r in parts])
            pair, inverse = np.unique(word * 128 + code, return_inverse=True)
            n = np.bincount(inverse, np.concatenate([_array(r[5], np.int32) for r in parts]))
            word, code = pair >> 7, pair & 127
            movable = (now == RARE_CLASS) if turn is None else (now == RARE_CLASS) | ((keys >> 3) % 2 == turn % 2)
            movable &= now != END_CLASS
            use = movable[word]
            word, code, n = word[use], code[use], n[use]
            if len(word):
                best = best_classes(word, code, n, len(keys), now, cells)
                seen = np.unique(word)
                now = now.copy()
                now[seen] = best[seen]
        yield _rows([(shard, PLACED, 0, _pack(now, np.uint8))])

    return stored(gathered(counts, placed, near, run=run), "placed")


def cells_of(rows: DataFrame) -> np.ndarray:
    """The class bigram table; WIDTH * WIDTH numbers at most reach the driver."""
    out = np.zeros(WIDTH * WIDTH, np.int64)
    for r in rows.filter(F.col("kind") == CELLS).groupBy("at").agg(F.sum("other").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(WIDTH, WIDTH)


class Model:
    """Log10 probabilities of classes by the class before, and the unknown word's."""

    def __init__(self, cells: np.ndarray):
        known = cells[:, : RARE_CLASS + 1].astype(np.float64)
        plain = known[:UNKNOWN]
        frequency = (plain.sum(axis=0) + 0.5) / (plain.sum() + 0.5 * (RARE_CLASS + 1))
        total = known.sum(axis=1)
        once = cells[:, UNKNOWN].astype(np.float64)
        overall = (once[:UNKNOWN].sum() + 0.5) / (plain.sum() + 1)
        self.unknown = np.where(total > 0, (once + overall) / (total + 1), overall)
        self.unknown[UNKNOWN] = overall
        self.step = np.log10((known + frequency[None, :]) / (total[:, None] + 1)) + np.log10(1 - self.unknown)[:, None]
        self.size = np.maximum(plain.sum(axis=0), 1)


def scored(texts: DataFrame, found: DataFrame, model: Model, total: int, distinct: int) -> DataFrame:
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = [x.split()[0] for x in kinds.split(", ")]
    floor = np.log10(total + 0.1 * (distinct + 1))

    def run(block: int, rows: list[tuple]) -> pa.RecordBatch:
        tokens, lens, train, ids, found = _block(rows)
        classes, n = _classes(tokens, found)
        known = n > 0
        classes = np.where(known, classes, UNKNOWN).astype(np.uint8)
        own = classes[tokens]
        before = _before(own, lens)
        emit = np.where(known, np.log10(np.maximum(n, 1)) - np.log10(model.size[np.minimum(classes, RARE_CLASS)]), 0)
        step = np.concatenate([model.step, np.log10(model.unknown)[:, None]], axis=1)
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        base = np.add.reduceat((np.log10(n + 0.1) - floor)[tokens], starts)
        score = np.add.reduceat(step[before, own] + emit[tokens], starts)
        seen = np.add.reduceat(known[tokens].astype(np.int64), starts)
        arrays = [pa.array(ids, pa.int64()), pa.array(~train), pa.array(lens.astype(np.int64)), pa.array(seen), pa.array(np.full(len(ids), total, np.int64)), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(arrays, names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches):
            keys = t.column(0).to_numpy()
            for start, end in groups_in(keys):
                yield run(int(keys[start]), [tuple(r.values()) for r in t.slice(start, end - start).to_pylist()])

    parts = texts.unionByName(found).repartition("at").sortWithinPartitions("at", "kind", "other")
    return small_batches(parts).mapInArrow(blocks, kinds)


def class_scores(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every document."""
    shards = max(32, -(-docs.count() // 8192))
    rows = encoded(docs, shards)
    texts, words = rows.filter(F.col("kind") == TEXTS), rows.filter(F.col("kind") == WORDS)
    made = counted(words)
    counts = made.filter(F.col("kind") == COUNTS)
    sums = counts.agg(F.sum(F.col("ids")[0]), F.sum(F.col("ids")[1])).first()
    total, distinct = (int(x or 0) for x in sums)
    top = made.filter(F.col("kind") == TOP).orderBy(F.desc("other"), F.col("ids")[0]).limit(CLASSES).collect()
    founders = {END_KEY: END_CLASS} | {r["ids"][0]: k + 1 for k, r in enumerate(top)}
    placed = stored(founded(counts, founders), "placed")
    for k in range(passes + 1):
        least = LEAST_COUNT if k < passes else 1
        near = stored(around(texts, looked_up(words, counts, placed, least, counted=False), hapax=False), "around")
        was, placed = placed, moved(counts, placed, near.filter(F.col("kind") == AROUND), cells_of(near), k if k < passes else None)
        forget(near, was)
    found = stored(looked_up(words, counts, placed, 0, counted=True), "found")
    model = Model(cells_of(around(texts, found, hapax=True)))
    return scored(texts, found, model, total, distinct)
