from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np

from quire.llm import linededup
from tests.llm.data import documents, empty, rows

BLANK = " \t\n\x0b\x0c\r"


def key(line: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANK))


def brute(docs: list[tuple]) -> list[tuple]:
    holders = defaultdict(list)
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].append(i)
    out = []
    for i, t in docs:
        stay = []
        for x in (t or "").split("\n"):
            h = holders[key(x)]
            top = max((j for j in h if j is not None), default=None)
            gone = len(key(x)) >= 20 and len(h) >= 3 and top is not None and (i is None or i < top)
            stay += [] if gone else [x]
        n = (t or "").count("\n") + 1
        out.append((i, n, n - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    assert got(linededup.line_dedup(documents(spark))) == brute([(r[0], r[1]) for r in rows()])
    assert linededup.line_dedup(empty(spark)).count() == 0


def corpus(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    pool = [f"this is the shared line number {k}" for k in range(12)] + ["short", "x" * 19, "É" * 20]
    return [(k, "\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(1, 6)))) for k in range(n)]


def test_insertions_and_deletions_are_reversible(spark):
    docs = corpus(60, 1)
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    index = linededup.LineIndex(spark)
    index.insert(frame(docs[:30]))
    before = {tuple(r) for r in index.counts.collect()}
    added = index.insert(frame(docs[30:]))
    drops = index.decide(index.postings)
    assert got(linededup.without_lines(frame(docs), drops).selectExpr("doc_id", "_n_lines n_lines", "_n_dropped n_dropped", "sha2(text, 256) kept_sha256")) == brute(docs)
    assert added.count() > 0
    gone = [5, 17, 59, 58, 3]
    index.delete(spark.createDataFrame([(g,) for g in gone], "doc_id long"))
    left = [d for d in docs if d[0] not in gone]
    assert got(linededup.without_lines(frame(left), index.decide(index.postings)).selectExpr("doc_id", "_n_lines n_lines", "_n_dropped n_dropped", "sha2(text, 256) kept_sha256")) == brute(left)
    index.delete(spark.createDataFrame([(k,) for k in range(30, 60)], "doc_id long"))
    index.insert(frame([d for d in docs[:30] if d[0] in gone]))
    assert {tuple(r) for r in index.counts.collect()} == before


def test_many_batches(spark, monkeypatch):
    """Small levels, shards and filters, so that all are merged, grown and built anew on the way."""
    monkeypatch.setattr(linededup, "LEVELS", 3)
    monkeypatch.setattr(linededup, "KEYS_PER_SHARD", 4)
    rng = random.Random(8)
    pool = [f"this is the shared line number {k}" for k in range(40)]
    index, live, n = linededup.LineIndex(spark), [], 0
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    for step in range(7):
        if step % 3 == 2:
            gone = {rng.choice(live)[0] for _ in range(4)} | {None}
            index.delete(spark.createDataFrame([(g,) for g in gone], "doc_id long"))
            live = [d for d in live if d[0] not in gone]
        else:
            some = [(None if rng.random() < 0.2 else n + k - 2 * (k == 5), "\n".join(rng.sample(pool, 3))) for k in range(12)]
            n += 12
            index.insert(frame(some))
            live += some
        if step in (4, 6):
            kept = linededup.without_lines(frame(live), index.decide(index.postings))
            assert got(kept.selectExpr("doc_id", "_n_lines n_lines", "_n_dropped n_dropped", "sha2(text, 256) kept_sha256")) == brute(live)
    assert index.shards > 1


def test_an_overflowing_filter_is_built_anew(spark, monkeypatch):
    monkeypatch.setattr(linededup, "MAX_KICKS", 2)
    index = linededup.LineIndex(spark)
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    docs = [(k, f"a line that three documents share, {k // 3}") for k in range(900)]
    index.insert(frame(docs[:9]))
    index.insert(frame(docs[9:]))
    assert index.filters.filter("filter is null").isEmpty()
    assert got(linededup.without_lines(frame(docs), index.decide(index.postings)).selectExpr("doc_id", "_n_lines n_lines", "_n_dropped n_dropped", "sha2(text, 256) kept_sha256")) == brute(docs)


def test_many_hot_keys_meet_salted(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", 0)
    docs = corpus(60, 3)
    assert got(linededup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_cuckoo_filter_never_forgets():
    rng = np.random.default_rng(0)
    hi, lo = rng.integers(-(2**63), 2**63, (2, 5000), dtype=np.int64)
    f = linededup.CuckooFilter.sized(5000)
    assert f.insert(hi, lo) and f.holds(hi, lo).all()
    other = rng.integers(-(2**63), 2**63, (2, 20000), dtype=np.int64)
    assert f.holds(*other).mean() < 0.001
    f.remove(hi[:2500], lo[:2500])
    again = linededup.CuckooFilter.from_bytes(f.to_bytes())
    assert again.holds(hi[2500:], lo[2500:]).all() and again.holds(hi[:2500], lo[:2500]).mean() < 0.01


def test_an_overfull_filter_says_so():
    rng = np.random.default_rng(0)
    f = linededup.CuckooFilter.sized(4)
    assert not f.insert(*rng.integers(-(2**63), 2**63, (2, 500), dtype=np.int64))
