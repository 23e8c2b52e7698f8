from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.llm import graph, neardup
from tests.llm.data import documents, empty, of_texts, rows


def sets_of(texts, words):
    out = []
    for t in texts:
        k = (t or "").encode().lower().split()
        out.append({tuple(k[j : j + words]) for j in range(len(k) - words + 1)} if len(k) >= words else {tuple(k)} if k else set())
    return out


def brute(texts, words, percent):
    sets, parent = sets_of(texts, words), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(sets))], [len(s) for s in sets]


def corpus(seed, groups=12, size=8, words=60):
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(400)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                own[rng.randrange(words)] = rng.choice(vocab)
            texts.append(" ".join(own))
    return [*texts, "", None, "one two", "One  two", "one"]


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, words, percent):
    texts = corpus(words)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(of_texts(spark, texts), words, percent).collect()}
    roots, sizes = brute(texts, words, percent)
    assert [got[k]["component_id"] for k in range(len(texts))] == roots
    assert [got[k]["n_shingles"] for k in range(len(texts))] == sizes
    assert all(got[k]["kept"] == (roots[k] == k) for k in got)


def test_large_nodes_and_split_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_NODE", 6)
    monkeypatch.setattr(neardup, "GROUP", 8)
    texts = corpus(9, groups=4, size=30)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(of_texts(spark, texts), 3, 85).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, 3, 85)[0]


def test_groups_of_long_texts_are_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP_VALUES", 300)
    texts = corpus(4, groups=3, size=14)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(of_texts(spark, texts), 5, 80).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, 5, 80)[0]


def test_a_chain_longer_than_its_blocks(spark, monkeypatch):
    """Each text is linked to the next only, so hardly any is with the pivot after the first round."""
    monkeypatch.setattr(neardup, "GROUP", 4)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words[3 * k : 3 * k + 60]) for k in range(25)] + ["other text " * 9]
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string")
    members = neardup.set_rows(rows, "row", 3).select("sid", "row", "n").withColumn("group", F.lit(bytearray(b"g")))
    large = members.groupBy("group").agg(F.min("sid").alias("pivot")).withColumn("blocks", F.lit(6).cast("long"))
    placed, rest = neardup.dealt(members, large)
    links = neardup.group_links(placed.join(rows.select("row", "text"), "row"), 3, 85)
    again = neardup.second_round(rest, graph.components(links))
    links = links.unionByName(neardup.group_links(again.join(rows.select("row", "text"), "row"), 3, 85))
    found = graph.components(links).join(members, F.col("node") == F.col("sid")).collect()
    roots = {r["row"]: r["root"] for r in found}
    assert set(roots) == set(range(25)) and len(set(roots.values())) == 1


def test_rows_that_repeat_an_id(spark):
    base = [f"w{k}" for k in range(60)]
    a, b, c = list(base), list(base), list(base)
    b[10], b[40], c[55] = "x", "y", "z"
    a, b, c = (" ".join(t) for t in (a, b, c))
    (ra, rb, rc), _ = brute([a, b, c], 3, 85)
    assert ra == rc != rb
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame([(5, a), (5, b), (3, c)]), 3, 85).collect()}
    assert got == {(5, 3, False), (5, 5, True), (3, 3, True)}
    kept = [tuple(r) for r in neardup.deduplicated(frame([(3, a), (5, a), (5, "quite another text of words"), (5, a), (None, a), (7, ""), (7, "")])).collect()]
    assert sorted(kept, key=str) == sorted([(3, a), (5, "quite another text of words"), (None, a), (7, ""), (7, "")], key=str)


def test_odd_rows(spark):
    got = neardup.near_duplicates(documents(spark)).collect()
    assert len(got) == len(rows())
    null = [r for r in got if r["doc_id"] is None]
    assert null[0]["component_id"] is None and null[0]["kept"]
    twice = [r for r in got if r["doc_id"] == 9]
    assert {r["component_id"] for r in twice} == {7, 9}
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    same = {}
    for n, r in got.items():
        assert same.setdefault(root(n), r) == r
    assert len(set(same.values())) == len(same) and set(got) == {x for e in edges if e[0] != e[1] for x in e}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_agreement_is_the_share_of_equal_values(spark):
    import numpy as np

    a = np.arange(neardup.COORDS, dtype=np.uint16)
    b = a.copy()
    b[:16] += 1
    df = spark.createDataFrame([(bytearray(a.tobytes()), bytearray(b.tobytes()))], "x binary, y binary")
    assert df.select(F.expr(neardup.agreement("x", "y")).alias("r")).first()["r"] == 0.75
