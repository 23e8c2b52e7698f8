from __future__ import annotations

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from quire.llm import mixing, packing
from quire.llm import queries as llm
from tests.compare import same
from tests.llm.data import documents, empty, of_texts, rows


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_matches_sql(spark, sf, name):
    same(llm.QUERIES[name](spark, sf), llm.ORACLES[name], sf)


def padding(lengths, edges):
    return sum(min(e for e in edges if e >= n) - n for n in lengths)


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(40):
        lengths = [rng.randint(0, 12) for _ in range(rng.randint(1, 20))]
        own = sorted(set(lengths))
        count = np.array([lengths.count(x) for x in own])
        got = packing.boundaries(np.array(own), count, 3)
        best = min(padding(lengths, (*c, own[-1])) for k in range(min(3, len(own))) for c in itertools.combinations(own[:-1], k))
        assert got[-1] == own[-1] and len(got) <= 3 and padding(lengths, got) == best
    assert packing.boundaries(np.array([]), np.array([])) == []


def plain_program(length, count, buckets):
    """The same program, every cut tried, the smallest best one kept."""
    n, big = len(length), 1 << 60
    best, steps = [0] + [big] * n, []
    for _ in range(min(buckets, n)):
        now, came = [big] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(j):
                cost = best[i] + sum(int(count[x]) * int(length[j - 1] - length[x]) for x in range(i, j))
                if cost < now[j]:
                    now[j], came[j] = cost, i
        steps.append(came)
        best = now
    edges, j = [], n
    for came in reversed(steps):
        edges.append(int(length[j - 1]))
        j = came[j]
    return edges[::-1]


def test_boundaries_against_the_plain_program():
    rng = np.random.default_rng(3)
    for _ in range(30):
        length = np.unique(rng.integers(0, 400, rng.integers(1, 45)))
        count = rng.integers(1, 6, len(length))
        buckets = int(rng.integers(1, 9))
        assert packing.boundaries(length, count, buckets) == plain_program(length, count, buckets)
    length = np.arange(1, 200_001)
    assert packing.boundaries(length, np.ones(len(length), np.int64), 4) == [50_000, 100_000, 150_000, 200_000]


def test_every_length_has_its_own_bin(spark):
    lens = spark.createDataFrame([(k, n, "") for k, n in enumerate([8191, 8192, 8193, 8193, 16384, 16385, 2**40, 2**40 + 1])], "doc_id long, n_tokens long, pick string")
    length, count = packing.histogram(lens)
    assert length.tolist() == [8191, 8192, 8193, 16384, 16385, 2**40, 2**40 + 1] and count.tolist() == [1, 1, 2, 1, 1, 1, 1]


def test_one_word_more_than_the_rest(spark):
    texts = ["w " * 8192] * 100 + ["w " * 8193]
    got = packing.packed(of_texts(spark, texts), buckets=2).collect()
    assert {(r["n_tokens"], r["bucket_len"]) for r in got} == {(8192, 8192), (8193, 8193)}


def test_rows_alike_take_places_of_their_own(spark):
    some = [(None if k % 2 else k, "a b c", "en", "a", 0, 0.0, 0, 0, "", 0, "") for k in range(200)]
    got = packing.packed(documents(spark, some).repartition(7), buckets=2, budget=30).collect()
    assert sorted((r["batch"], r["place"]) for r in got) == [(k // 10, k % 10) for k in range(200)]
    mixed = mixing.mixed_sizes(documents(spark, some).repartition(7), block_words=7).collect()
    assert len(mixed) == 200 and sum(r["taken"] for r in mixed) == 600


def test_batches_keep_the_budget(spark):
    got = packing.packed(documents(spark), buckets=3, budget=64).collect()
    assert len(got) == len(rows())
    batches = defaultdict(list)
    for r in got:
        assert r["n_tokens"] <= r["bucket_len"]
        batches[r["bucket"], r["batch"]].append(r)
    for own in batches.values():
        assert len(own) == 1 or len(own) * own[0]["bucket_len"] <= 64
        assert sorted(r["place"] for r in own) == list(range(len(own)))
    assert packing.packed(empty(spark)).count() == 0


def waterfill(size, weight):
    """Shares by weight, the excess over three times the size reshared until none is above."""
    total, fixed = sum(size.values()), {}
    while True:
        left = {s: w for s, w in weight.items() if s not in fixed}
        rest = total - sum(fixed.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = {s: 3 * size[s] for s in left if share[s] > 3 * size[s]}
        if not over:
            return fixed | share
        fixed |= over


def test_targets_against_the_iteration(spark):
    rng = random.Random(2)
    for _ in range(6):
        names = [None if k == 7 else f"s{k}" for k in range(rng.randint(1, 8))]
        size = {n: rng.choice([0, 1, 5, 60, 900]) for n in names}
        order = sorted(names, key=lambda n: (n is None, n or ""))
        weight = {n: mixing.WEIGHTS[k % 3] for k, n in enumerate(order)}
        df = spark.createDataFrame([(n, v) for n, v in size.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = waterfill(size, weight)
        assert all(got[n] == pytest.approx(want[n]) for n in names)


def test_mix_takes_its_targets(spark):
    rng = random.Random(4)
    some = [(k, " ".join(["w"] * rng.randint(0, 90)), "en", ["a", "b", "c", None][min(3, k % 7)], 0, 0.0, 0, 0, "", 0, "") for k in range(150)]
    got = mixing.mixed_sizes(documents(spark, some), block_words=16).collect()
    again = mixing.mixed_sizes(documents(spark, some), block_words=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == 150
    by = defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["target"], r["source_size"]].append(r["taken"])
    assert all(abs(sum(v) - t) <= 1 for (t, _), v in by.items())


def test_slots_are_spread(spark):
    targets = spark.createDataFrame([(0, 1600, 0.0, 0.5), (1, 800, 0.5, 0.75), (2, 800, 0.75, 1.0)], "idx long, need long, low double, high double")
    slots = [r["idx"] for r in mixing.schedule(targets, 16).orderBy("slot").collect()]
    assert len(slots) == 200
    for a in range(0, 180, 20):
        assert 8 <= slots[a : a + 20].count(0) <= 12


def test_slots_of_documents_are_spread(spark):
    """In every stretch of the schedule each source has about its share of the first slots."""
    some = [(k, "w " * 16, "en", ["a", "b", "c"][k % 3], 0, 0.0, 0, 0, "", 0, "") for k in range(1200)]
    got = mixing.mixed_sizes(documents(spark, some), block_words=16).collect()
    share = {r["target"]: r["target"] / (1200 * 16) for r in got}
    assert len(share) == 3
    for a in range(0, 1000, 100):
        for target, part in share.items():
            n = sum(r["n_slots"] > 0 and r["target"] == target and a <= r["first_slot"] < a + 100 for r in got)
            assert n <= 100 * part + 4
    first = [r for r in got if r["n_slots"] and r["first_slot"] < 300]
    for target, part in share.items():
        assert abs(sum(r["target"] == target for r in first) - 300 * part) <= 6


def test_documents_in_the_order_of_their_slots(spark):
    rng = random.Random(6)
    some = [(k % 50, " ".join(["w"] * rng.randint(0, 40)), "en", ["a", "b"][k % 9 == 0], k, 0.0, 0, 0, "", 0, "") for k in range(120)]
    docs = documents(spark, some)
    out = mixing.in_order(docs, block_words=8)
    taken = mixing.mixed_sizes(docs, block_words=8)
    assert out.columns == docs.columns
    got = [r["n_chars"] for r in out.collect()]
    size = {k: len(t.split()) for _, t, _, _, k, *_ in some}
    assert set(got) <= set(size) and all(size[k] for k in got)
    assert abs(sum(size[k] for k in got) - sum(r["taken"] for r in taken.collect())) <= 2 * 2 * max(size.values())
    runs = sum(a[3] != b[3] for a, b in zip(*[[some[k] for k in got][j:] for j in (0, 1)], strict=False))
    assert runs > len(got) / 20


def test_odd_rows(spark):
    got = mixing.mixed_sizes(documents(spark)).collect()
    assert len(got) == len(rows()) and mixing.mixed_sizes(empty(spark)).count() == 0
    assert mixing.mixed_sizes(of_texts(spark, [None, ""])).agg({"taken": "sum"}).first()[0] == 0
