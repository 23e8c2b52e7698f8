"""Queries over whole tables and whole texts: nothing past a row, rank or prefix is missing."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from quire.operators import workflow
from quire.plans import registry
from quire.plans import workflow as plans
from quire.session import table
from quire.sources import views


def test_every_document_has_a_place(spark, sf):
    n = table(spark, sf, "documents").count()
    got = registry.QUERIES["o03_natural_order"](spark, sf).collect()
    assert n > 100 and sorted(r["place"] for r in got) == list(range(1, n + 1))


def test_places_over_several_ranges(spark):
    rows = [(random.Random(k).choice([0, 1, 7, None]), k * 3 % 1000) for k in range(1000)]
    got = workflow.global_places(spark.createDataFrame(rows, "a long, b long"), "a", "b", width=50).orderBy("place").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert [r["place"] for r in got] == list(range(1, 1001))


def test_set_differences_reach_past_the_first_blocks(spark, sf):
    levels = {(r["source_id"], r["gid"]) for r in views.overlay(spark, sf)[0].select("source_id", "gid").collect()}
    blocks = {(r["source_id"], r["gid"]) for r in views.blocks(spark, sf).filter(F.col("type") == "text").select("source_id", "gid").collect()}
    got = {tuple(r) for r in registry.QUERIES["u03_set_differences"](spark, sf).collect()}
    assert got == blocks - levels and max(g for _, g in got) >= 7


def test_every_project_is_listed_in_order(spark, sf):
    n = views.blocks(spark, sf).select("source_id").distinct().count()
    got = [tuple(r) for r in registry.QUERIES["o07_largest_projects"](spark, sf).collect()]
    assert len(got) == n > 20 and got == sorted(got, key=lambda r: (-r[1], r[0]))


def test_evidence_keeps_forty_of_all_checks(spark, sf):
    found = [r.asDict() for r in plans._findings(spark, sf).collect()]
    want = []
    for source in {r["source_id"] for r in found}:
        own = [(r["check"], r["seq"], r["severity"]) for r in found if r["source_id"] == source and (r["severity"] == "high" or r["check"].startswith(plans.EVIDENCE_PREFIXES))]
        want += [(source, check, severity, seq) for check, seq, severity in sorted(own)[:40]]
    got = [tuple(r) for r in registry.QUERIES["p13_evidence"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and max(Counter(r[0] for r in got).values()) > 2 and len({r[1] for r in got}) > 2


def test_titles_reach_past_the_prefixes(spark, tmp_path):
    long = "a b " * 30 + r"\\*c\\* "
    spark.createDataFrame([(3, long + "!?end"), (4, "?" * 70 + "name")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {name: {r["doc_id"]: r for r in registry.QUERIES[name](spark, str(tmp_path)).collect()} for name in ("f10_clean_title", "f11_title_keys", "f19_site_tags", "f20_source_ids")}
    assert got["f10_clean_title"][3]["title"] == "a b " * 30 + "*c* !?end[1]"
    assert got["f11_title_keys"][3]["plain_key"].startswith("ab" * 30) and "end" in got["f11_title_keys"][3]["audit_key"]
    assert got["f19_site_tags"][3]["title"] == long + "!?end"
    assert got["f20_source_ids"][4]["source_id"].startswith("name.")


def test_authors_of_blocks(spark, sf):
    text_of = {(r["source_id"], r["gid"]): r["text"] for r in views.blocks(spark, sf).select("source_id", "gid", "text").collect()}
    got = registry.QUERIES["f12_authors"](spark, sf).collect()
    assert len(got) == len(text_of) and not any(r["authors"] for r in got if len("".join(text_of[r["source_id"], r["gid"]].split())) > 20)
