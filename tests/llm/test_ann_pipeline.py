from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from quire.llm import ann
from tests.llm.data import documents, empty


def table(spark, vectors):
    return spark.createDataFrame(list(vectors), "vec_id long, embedding array<float>")


def brute(rows, every=50, k=5):
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in {i for i, _ in fine if i % every == 0}:
        best = {}
        for i, v in fine:
            for j, u in fine:
                if j == q and i != q and len(u) == len(v):
                    a, b = np.array(u, np.float32).astype(float), np.array(v, np.float32).astype(float)
                    best[i] = max(best.get(i, -2), a @ b / np.sqrt((a @ a) * (b @ b)))
        out[q] = sorted(((-round(s, 9), i) for i, s in best.items()))[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["vec_id"]))
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.standard_normal(8).astype(np.float32).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[50][1]) for k in range(9)] + [(2000, None), (2050, []), (2100, [0.0] * 8), (2150, [1.0, None] + [0.0] * 6), (2200, [float("nan")] * 8), (None, [1.0] * 8), (3000, [1.0, 2.0]), (3001, [2.0, 4.0]), (3050, [0.5])]
    want = {q: v for q, v in brute(rows).items() if v}
    assert found(ann.self_join(table(spark, rows))) == want
    assert ann.self_join(table(spark, [])).count() == 0


def test_repeated_rows_and_one_vector(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]
    assert found(ann.self_join(table(spark, rows))) == {0: [(-1.0, 1), (-1.0, 2), (0.0, 3)]}


@pytest.mark.parametrize("clustered", [True, False])
def test_recall(spark, monkeypatch, clustered):
    monkeypatch.setattr(ann, "PAGE_ROWS", 512)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 24))
    if clustered:
        x = x * 0.3 + rng.standard_normal((40, 24))[rng.integers(0, 40, 3000)]
    x = x.astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<double>")
    got = ann.nearest(rows, rows.filter("id % 50 = 0"), share=0.1 if clustered else 0.6, least=50)
    near = {}
    for r in got.collect():
        near.setdefault(r["query_id"], set()).add(r["vec_id"])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(near[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits / 300 >= 0.9


def test_vectors_of_one_direction_over_many_pages(spark, monkeypatch):
    monkeypatch.setattr(ann, "PAGE_ROWS", 32)
    monkeypatch.setattr(ann, "BLOCK_VALUES", 32)
    rows = [(k, [float(k + 1), 2.0 * (k + 1)]) for k in range(120)] + [(200 + k, [float(k), -1.0]) for k in range(120)]
    got = ann.nearest(*[table(spark, rows).selectExpr("vec_id id", "embedding vec").filter(f) for f in ("true", "id = 50 or id = 60")], share=0.0, least=5)
    for q in (50, 60):
        near = [r for r in got.collect() if r["query_id"] == q]
        assert len(near) == 5 and all(r["vec_id"] < 200 and r["score"] > 1 - 1e-12 for r in near)


def test_many_queries_share_a_vector(spark):
    rows = [(50 * k, [1.0, 0.5]) for k in range(40)] + [(50 * k + 1, [0.5, 1.0 + k]) for k in range(5)]
    want = brute(rows)
    assert found(ann.self_join(table(spark, rows))) == want


def test_pipeline_keeps_other_texts_of_a_repeated_id(spark, sf):
    same = " ".join(f"word{k}" for k in range(40))
    some = [(3, same), (5, same), (5, "an unrelated text that nothing else resembles at all")]
    docs = documents(spark, [(i, t, "en", "a", len(t), 0.0, 0, 0, "", 0, "") for i, t in some])
    kept = corpus_pipeline.without_near_copies(spark, docs, sf).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([some[0], some[2]])


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out = spark.createDataFrame(out.collect(), out.schema)
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    assert docs.count() > 0 and corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_of_odd_rows(spark, sf):
    for some in (documents(spark), empty(spark)):
        docs = some
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "packing":
                assert out.columns == some.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
    kept = corpus_pipeline.without_near_copies(spark, documents(spark), sf)
    assert {r["doc_id"] for r in kept.collect()} >= {1, 4, 5, None}
