"""Secret scan: fixed patterns, and a likelihood ratio of two character Markov models.

The patterns find assignments, access keys and hexadecimal runs. Beside them, every run
of ``CANDIDATE`` characters is scored by log P(run | random strings) - log P(run |
ordinary identifiers), both first-order character models smoothed towards how often each
character comes at all; runs above the thresholds that no pattern has touched are spans of kind ``markov``.

Training is from labelled samples: a table (text, label) with label 1 for random strings
and 0 for identifiers. ``corpus_samples`` makes one of the corpus itself: 1 for what the
patterns found and for digests of counters in three alphabets, 0 for the words of at
least 8 characters, in a sample of about ``SAMPLE_DOCS`` documents chosen by a checksum of
their id. That sample is the only part of the corpus that is bounded; the model is
2 * 95 * 95 counts at most.

Everything is built of DataFrame expressions. Positions come from what stands between the
matches: a match starts where the pieces and matches before it end.

Defined results: a null text is the empty text and has no spans; offsets are code points,
ends exclusive; every row gives one row; other columns are ignored; an empty table gives
an empty table (and trains on the counters' digests alone).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, the group that is measured and its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the same matches as [0-9a-f]+ of 16 or more, as a match is a whole run
BASE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))

CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
LEAST_LLR, LEAST_MEAN_LLR = 12.0, 0.6
SAMPLE_DOCS = 5000
RANDOM_ROWS = 2000
FIRST, SIZE = 32, 95  # printable ASCII
BACK_OFF, FLOOR = 10.0, 0.5
STRIDE = 64

SPANS = "array<struct<s:int,k:int,e:int,v:string>>"


def matches(text: str, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans of a pattern in a text column (by name), in order; matches with a short group are dropped.

    A match begins after the pieces and matches before it. Their lengths are summed for every
    STRIDE of them first, so the time grows with the number of matches and not its square.
    """
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    let = lambda name, value, then: f"element_at(transform(array({value}), {name} -> {then}), 1)"
    total = lambda first, n: f"aggregate(slice(l, {first}, {n}), 0, (s, x) -> s + x)"
    strides = f"transform(sequence(0, cast((size(l) - 1) div {STRIDE} as int)), c -> {total(f'c * {STRIDE} + 1', STRIDE)})"
    before = f"aggregate({strides}, array(0), (s, x) -> concat(s, array(element_at(s, -1) + x)))"
    start = f"b[cast(i div {STRIDE} as int)] + {total(f'cast(i div {STRIDE} as int) * {STRIDE} + 1', f'i % {STRIDE}')} + length(z.a[i])"
    spans = f"transform(transform(z.m, (m, i) -> {start}), (s, i) -> named_struct('s', s, 'k', {kind}, 'e', s + length(z.m[i]), 'v', z.g[i]))"
    found = f"named_struct('a', split({text}, {p}, -1), 'm', regexp_extract_all({text}, {p}, 0), 'g', regexp_extract_all({text}, {p}, {group}))"
    lengths = "transform(z.m, (m, i) -> length(z.a[i]) + length(m))"
    made = let("z", found, let("l", lengths, let("b", before, f"filter({spans}, y -> length(y.v) >= {least})")))
    return F.expr(f"if({text} rlike {p}, cast({made} as {SPANS}), cast(array() as {SPANS}))")


def with_base(docs: DataFrame) -> DataFrame:
    """(doc_id, text, assign, access, hex): the base spans of every document."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.select("*", *[matches("text", p, g, n, k).alias(name) for k, (name, p, g, n) in enumerate(BASE)])


def corpus_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled samples (text, label) from a bounded, fixed choice of documents."""
    share = max(1, docs.count() // sample_docs)
    chosen = docs.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % share == 0)
    base = with_base(chosen)
    secrets = base.select(F.explode(F.concat("assign", "access", "hex")).alias("x")).select(F.col("x.v").alias("text"), F.lit(1).alias("label"))
    words = base.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_+/=-]{8,}"), F.lit(0))).alias("text"))
    words = words.groupBy("text").agg(F.count("*").alias("n")).filter(~F.col("text").rlike("[0-9]")).select("text", F.lit(0).alias("label"))
    made = docs.sparkSession.range(RANDOM_ROWS).select(F.sha2(F.col("id").cast("string"), 256).alias("hex"))
    made = made.select(F.explode(F.array(F.substring("hex", 1, 40), F.substring(F.base64(F.unhex("hex")), 1, 40), F.substring(F.upper(F.regexp_replace(F.base64(F.unhex("hex")), "[^A-Za-z0-9]", "")), 1, 20))).alias("text"), F.lit(1).alias("label"))
    return secrets.unionByName(words).unionByName(made)


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of neighbouring characters, row-major."""
    codes = F.expr(f"filter(transform(split(text, ''), c -> ascii(c) - {FIRST}), c -> c >= 0 and c < {SIZE})")
    pairs = samples.select("label", codes.alias("c")).filter("size(c) > 1")
    pairs = pairs.select("label", F.explode(F.expr(f"transform(sequence(2, size(c)), i -> c[i - 2] * {SIZE} + c[i - 1])")).alias("pair"))
    rows = pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()
    models = []
    for label in (1, 0):
        count = [[0] * SIZE for _ in range(SIZE)]
        for r in rows:
            if r["label"] == label:
                count[r["pair"] // SIZE][r["pair"] % SIZE] += r["n"]
        comes = [sum(count[first][second] for first in range(SIZE)) for second in range(SIZE)]
        plain = [(n + FLOOR) / (sum(comes) + FLOOR * SIZE) for n in comes]
        models.append([[(count[first][second] + BACK_OFF * plain[second]) / (sum(count[first]) + BACK_OFF) for second in range(SIZE)] for first in range(SIZE)])
    return [math.log(models[0][first][second]) - math.log(models[1][first][second]) for first in range(SIZE) for second in range(SIZE)]


def llr(text: str, table: list[float]) -> str:
    """SQL for the log-likelihood ratio of a string of candidate characters."""
    lut = f"cast(split('{','.join(format(v, '.6g') for v in table)}', ',') as array<double>)"
    return f"""aggregate(transform(split({text}, ''), c -> ascii(c) - {FIRST}), named_struct('p', -1, 's', 0D),
        (a, c) -> named_struct('p', c, 's', if(a.p < 0, 0D, a.s + {lut}[a.p * {SIZE} + c])), a -> a.s)"""


def with_spans(docs: DataFrame, table: list[float]) -> DataFrame:
    """with_base plus markov: runs like random strings that no base span touches."""
    rows = with_base(docs).withColumn("base", F.concat("assign", "access", "hex"))
    rows = rows.withColumn("run", matches("text", CANDIDATE, 0, 16, len(BASE)))
    free = F.expr("filter(run, c -> not exists(base, b -> b.s < c.e and c.s < b.e))")
    rows = rows.withColumn("run", free)
    scored = F.expr(f"filter(transform(run, c -> named_struct('c', c, 'r', {llr('c.v', table)})), y -> y.r >= {LEAST_LLR} and y.r >= {LEAST_MEAN_LLR} * (length(y.c.v) - 1))")
    return rows.withColumn("markov", F.transform(scored, lambda y: y["c"]))


def joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{n}'" for n, *_ in BASE) + ", 'markov')"
    return F.expr(f"array_join(transform(array_sort(transform({spans}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))), x -> concat_ws(':', {names}[x.k], x.s, x.e)), ',')")


def scan(docs: DataFrame, table: list[float]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256 and spans for every document."""
    rows = with_spans(docs, table)
    counts = [F.size(name).cast("long").alias(f"n_{name}") for name in ("assign", "access", "hex", "markov")]
    return rows.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("concat(base, markov)").alias("spans"))

