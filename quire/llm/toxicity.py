"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a learned lexicon, nearness of its words to the second
person, capitals, punctuation and obfuscation rates. The lexicon holds words and word
beginnings that labelled toxic documents have far more often than others; it is learned
from the labels, by language or not as the labels have it. Words written with digits and
signs for letters are looked up as they are meant.

Fitting takes a sample of labelled rows of at most ``SAMPLE_ROWS``, the first by a hash of
their id; equal texts count once. The sample's ids are the only thing that is broadcast,
so its bound is proven. Lexicon entries must pass a likelihood-ratio test whose level
falls with the number of entries tried. The sample is dealt into ``FOLDS``; features of
sample rows come from the lexicon of the other folds, and calibration is fitted to scores
from the other folds' trees, so neither sees its own labels.

Defined results: a null text is the empty text, which is scored like any other; labels
that are null are ignored, and an id labelled more than once is toxic if any label says
so; every row of the documents gives one row; columns other than doc_id and text never
enter a score; without labels, or with labels of one kind only, the score is their share
of toxic rows (0 without labels); an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm._common import small_batches, stored

SAMPLE_ROWS, SAMPLE_TASKS = 40000, 48
LEXICON = 5000
PREFIXES = (4, 5, 6)
LEAST_SUPPORT = 3
THRESHOLD = 0.3
FOLDS = 5
TREES, TREE_DEPTH, RATE, BINS, L2 = 40, 3, 0.2, 32, 1.0

#: Second-person words of the languages at hand.
SECOND = frozenset("you your yours yourself u ur ya du dich dir dein deine euch tu te toi ton ta tes vous votre usted ustedes tú ti tuyo vosotros".split())
#: Letters that digits and signs stand for.
MEANT = str.maketrans("013457@$!|", "oieastasil")

UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SHOUTED, STRETCHED = re.compile(rb"\b[A-Z]{3,}\b"), re.compile(rb"([A-Za-z])\1\1")
OBFUSCATED = re.compile(r"(?=.*[a-z])[a-z]+[0-9@$!|*]+[a-z]+[a-z0-9@$!|*]*$")

FEATURES = (
    "hits", "hits_per_100", "distinct_hits", "max_weight", "top3_weight", "sum_weight", "hits_near_second", "second_per_100", "nearest_second",
    "capitals", "shouted_per_100", "stretched_per_100", "exclamations", "questions", "punctuation", "obfuscated_per_100", "obfuscated_hits", "log_tokens",
)


def units(token: str) -> list[str]:
    """What the lexicon may hold of a token: itself, and its beginnings, marked with a star."""
    return [token, *(token[:n] + "*" for n in PREFIXES if len(token) > n)]


def plain(token: bytes) -> tuple[str, bool]:
    """A lower-case token without its outer punctuation, as meant, and whether it was obfuscated."""
    word = token.strip(PUNCTUATION.replace(b"@", b"").replace(b"$", b"")).decode(errors="replace").strip("«»“”„…¡¿")
    if OBFUSCATED.match(word):
        return word.translate(MEANT).replace("*", ""), True
    return word, False


class _Codes(dict):
    """token -> weight + 100 if second person + 1000 if obfuscated, memoised."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: bytes) -> float:
        if len(self) > 500_000:
            self.clear()
        word, hidden = plain(token)
        weight = max((self.lexicon.get(u, 0.0) for u in units(word)), default=0.0)
        found = self[token] = min(weight, 99.0) + 100 * (word in SECOND) + 1000 * hidden
        return found


def dense_features(text: str | None, codes: _Codes) -> list[float]:
    raw = (text or "").encode()
    tokens = raw.lower().split()
    n = len(tokens)
    code = np.fromiter(map(codes.__getitem__, tokens), np.float64, n)
    hidden = code >= 1000
    code = code - 1000 * hidden
    second = code >= 100
    weight = code - 100 * second
    at, you = np.flatnonzero(weight > 0), np.flatnonzero(second)
    per = 100 / max(n, 1)
    top = np.sort(weight[at])[::-1]
    near, nearest = 0, 50.0
    if len(at) and len(you):
        k = np.searchsorted(you, at)
        gap = np.minimum(np.abs(at - you[np.minimum(k, len(you) - 1)]), np.abs(at - you[np.maximum(k - 1, 0)]))
        near, nearest = int((gap <= 5).sum()), float(min(50, gap.min()))
    capitals = len(raw) - len(raw.translate(None, UPPER))
    letters = capitals + len(raw) - len(raw.translate(None, LOWER))
    chars = max(len(raw), 1)
    return [
        len(at), len(at) * per, len({tokens[i] for i in at.tolist()}), float(top[0]) if len(top) else 0.0, float(top[:3].mean()) if len(top) else 0.0, float(np.log1p(top.sum())),
        near, len(you) * per, nearest, capitals / max(letters, 1), sum(1 for _ in SHOUTED.finditer(raw)) * per, sum(1 for _ in STRETCHED.finditer(raw)) * per,
        raw.count(b"!") * per, raw.count(b"?") * per, (len(raw) - len(raw.translate(None, PUNCTUATION))) / chars, float(hidden.sum()) * per, float((hidden & (weight > 0)).sum()), float(np.log1p(n)),
    ]


@dataclass
class Trees:
    """Boosted trees of a fixed depth on binned features; node k's children are 2k + 1 and 2k + 2."""

    edges: list[np.ndarray]
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(TREE_DEPTH):
                at = 2 * at + 1 + (b[np.arange(len(x)), feature[at]] > cut[at])
            out += value[at - (2**TREE_DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss on feature histograms."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    for f, e in enumerate(edges):  # mostly one value: cut between the rare ones as well
        rare = x[:, f][x[:, f] > e[-1]] if len(e) else x[:, f]
        edges[f] = np.unique(np.concatenate([e, np.quantile(rare, [0, 0.25, 0.5, 0.75])])) if len(rare) else e
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    model = Trees(edges, float(np.log(share / (1 - share))))
    b, score, width = model.binned(x), np.full(len(y), model.base), BINS + 8
    inner, leaves = 2**TREE_DEPTH - 1, 2**TREE_DEPTH
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p) + 1e-9
        feature, cut = np.zeros(inner, np.int64), np.full(inner, width)
        at = np.zeros(len(y), np.int64)
        for level in range(TREE_DEPTH):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-9)
            for f in range(x.shape[1]):
                key = (at - first) * width + b[:, f]
                gs, hs = (np.bincount(key, v, nodes * width).reshape(nodes, width).cumsum(axis=1) for v in (g, h))
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + L2) + (ga - gs) ** 2 / (ha - hs + L2) - ga**2 / (ha + L2)
                k = gain.argmax(axis=1)
                better = gain[np.arange(nodes), k] > best
                best = np.where(better, gain[np.arange(nodes), k], best)
                feature[first : first + nodes][better], cut[first : first + nodes][better] = f, k[better]
            at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        score += value[leaf]
        model.feature.append(feature), model.cut.append(cut), model.value.append(value)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the non-decreasing fit, by pooling adjacent violators."""
    blocks: list[list[float]] = []  # sum of labels, rows, first score, last score
    values, inverse = np.unique(score, return_inverse=True)
    sums, rows = np.bincount(inverse, y), np.bincount(inverse)
    for v, s, n in zip(values.tolist(), sums.tolist(), rows.tolist(), strict=True):
        blocks.append([s, n, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, blocks[-1][2], last]
    knots = [(x, (s + 0.5 * len(y) ** -0.5) / (n + len(y) ** -0.5)) for s, n, first, last in blocks for x in ((first, last) if first < last else (first,))]
    xs, ps = np.array(knots).T
    return xs, np.maximum.accumulate(ps)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0, 1)


def checksum(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic, fold) of at most ``sample_rows`` labelled rows, equal texts once: those of the smallest hashes."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    first = rows.groupBy("digest").agg(F.min_by(F.struct("text", "toxic"), "doc_id").alias("r"))
    sample = stored(first.select("r.text", "r.toxic", (F.crc32("digest") % FOLDS).cast("int").alias("fold"), F.struct(F.xxhash64("digest").alias("h"), "digest").alias("place")), "toxic-sample")
    if sample.count() > sample_rows:  # ids that repeat
        last = sample.select("place").orderBy("place").limit(sample_rows).agg(F.max("place").alias("last"))
        sample = sample.join(F.broadcast(last), F.col("place") <= F.col("last")).drop("last")
    return sample.drop("place").repartition(SAMPLE_TASKS, F.xxhash64("text"))


def lexicons(sample: DataFrame, entries: int = LEXICON) -> tuple[list[dict[str, float]], dict[str, float]]:
    """For each fold the lexicon of the others, and that of the whole sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(found)
            out = pa.RecordBatch.from_arrays([pa.array([u for u, _, _ in keys], pa.string()), pa.array([h for _, h, _ in keys], pa.int32()), pa.array([t for _, _, t in keys], pa.int32()), pa.array(list(found.values()), pa.int64())], ["unit", "fold", "toxic", "n"])
            found.clear()
            return out

        for b in batches:
            for text, toxic, fold in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = {plain(t)[0] for t in set((text or "").encode().lower().split())} - {""}
                found.update((u, fold, toxic) for u in {u for w in words for u in units(w)})
            if len(found) > 500_000:
                yield flush()
        yield flush()

    counted = small_batches(sample.select("text", "toxic", "fold")).mapInArrow(count, "unit string, fold int, toxic int, n long")
    by = [F.sum(F.when((F.col("fold") == h) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{h}{t}") for h in range(FOLDS) for t in (0, 1)]
    table = stored(counted.groupBy("unit").agg(*by).filter(" + ".join(f"n{h}{t}" for h in range(FOLDS) for t in (0, 1)) + f" >= {LEAST_SUPPORT}"), "units")
    rows = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    tried = max(1, table.count())

    def best(folds: list[int]) -> dict[str, float]:
        bad, good = (sum(rows.get((h, t), 0) for h in folds) for t in (1, 0))
        if not bad or not good:
            return {}
        t, c = ("+".join(f"n{h}{k}" for h in folds) for k in (1, 0))
        share = bad / (bad + good)
        entry = table.selectExpr("unit", f"cast({t} as double) as t", f"cast({c} as double) as c").filter(f"t >= {LEAST_SUPPORT}")
        g = f"2 * (t * ln(t / ((t + c) * {share})) + if(c > 0, c * ln(c / ((t + c) * {1 - share})), 0D))"
        entry = entry.selectExpr("unit", "t", f"{g} as g", f"ln((t + 0.5) / {bad + 1.0}) - ln((c + 0.5) / {good + 1.0}) as w")
        entry = entry.filter((F.col("w") >= 1.5) & (F.col("g") >= 2 * float(np.log(tried)) + 1))
        return {r["unit"]: r["w"] for r in entry.orderBy(F.desc("g"), "unit").limit(entries).collect()}

    return [best([h for h in range(FOLDS) if h != out]) for out in range(FOLDS)], best(list(range(FOLDS)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of the labelled rows given; the caller leaves out what must not be learned."""
    sample = labelled_sample(docs, labels, sample_rows)
    others, whole = lexicons(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [_Codes(x) for x in others]
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([dense_features(t, own[h]) for t, _, h in rows], pa.list_(pa.float64()))], ["toxic", "fold", "x"])

    got = small_batches(sample.select("text", "toxic", "fold")).mapInArrow(run, "toxic int, fold int, x array<double>").toArrow()
    y, fold = got["toxic"].to_numpy().astype(float), got["fold"].to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return Model({}, None, None, float(y.mean()) if len(y) else 0.0)
    x = np.array(got["x"].to_pylist())
    order = np.lexsort([*x.T, y, fold])  # the sample has no order of its own
    x, y, fold = x[order], y[order], fold[order]
    out = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for h in range(FOLDS):
        if len(set(y[fold != h])) == 2 and (fold == h).any():
            out[fold == h] = boost(x[fold != h], y[fold != h]).raw(x[fold == h])
    return Model(whole, boost(x, y), isotonic(out, y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column _score."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(model.lexicon)
        for b in batches:
            x = np.array([dense_features(t, codes) for t in b.column(at).to_pylist()]).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], [*names, "_score"])

    return small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())]))


def train_labels(labels: DataFrame) -> DataFrame:
    """The labelled rows that may be learned from: those not held out."""
    return labels.filter(checksum(F.col("doc_id")) % 4 != 2)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    out = scored(docs.select("doc_id", "text"), fit(docs, train_labels(labels)))
    return out.select("doc_id", (checksum(F.col("doc_id")) % 4 == 2).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
