from __future__ import annotations

import json

import pytest

from quire.operators import calibration
from quire.sources import projects


def test_both_formats_of_content_lists(spark):
    lists = [
        [{"type": "text", "text": "a", "text_level": "1", "page_idx": 2}, {"text": "no type"}, {"type": "list", "text": "x", "list_items": [" one ", "", "two"]}],
        [{"content": {"type": "image", "img_path": "i.png", "image_caption": [], "table_caption": ["c"], "text_level": True}}],
    ]
    docs = spark.createDataFrame([(7, k + 1, json.dumps(x)) for k, x in enumerate(lists)], "source_id long, shard_ord long, json string")
    got = projects.blocks(projects.raw_items(docs)).orderBy("gid").collect()
    assert [(r["gid"], r["shard_ord"], r["local"], r["type"], r["text"]) for r in got] == [(0, 1, 0, "text", "a"), (1, 1, 2, "list", "x\none\ntwo"), (2, 2, 0, "image", "")]
    assert got[0]["text_level"] == 1 and got[0]["page_idx"] == 2 and got[2]["caption"] == ["c"] and got[2]["img_path"] == "i.png"


def test_content_list_must_be_a_list(spark):
    docs = spark.createDataFrame([(1, 1, "{}")], "source_id long, shard_ord long, json string")
    with pytest.raises(Exception, match="must be a JSON list"):
        projects.raw_items(docs).collect()


def test_resolving_names(spark):
    names = spark.createDataFrame([("alpha.1",), ("alphabet",), ("beta",)], "source_id string")
    assert projects.resolve(names, "beta") == "beta"
    assert projects.resolve(names, "bet") == "beta"
    assert projects.resolve(names, "alpha.") == "alpha.1"
    with pytest.raises(LookupError):
        projects.resolve(names, "alpha")
    with pytest.raises(LookupError):
        projects.resolve(names, "gamma")


def test_observations_take_the_first_of_a_page(spark):
    rows = [(1, 1, 0, 0, "page_number", "１"), (1, 1, 0, 1, "page_number", "9"), (1, 1, 1, 2, "header", "附录 3"), (1, 1, 1, 3, "header", "附录"), (1, 1, 2, 4, "text", "5"), (1, 1, 3, 5, "page_number", "x")]
    got = calibration.observations(spark.createDataFrame(rows, "source_id long, shard_ord long, page_idx long, gid long, type string, text string"))
    assert {(r["page_idx"], r["kind"], r["printed"]) for r in got.collect()} == {(0, "page_number", 1), (1, "header", 3)}


def test_weak_observations_degrade(spark):
    obs = spark.createDataFrame([(1, 1, 0, 5, "page_number"), (1, 1, 9, 14, "page_number")], "source_id long, shard_ord long, page_idx long, printed long, kind string")
    segs = calibration.calibrated(obs)
    v = calibration.verdict(segs, calibration.continuity(segs)).first()
    assert (v["verdict"], v["locator_type"]) == ("degraded", "section_only")


def test_ambiguous_front_numbers_are_qualified(spark):
    rows = [(1, s, p, p + 1, "page_number") for s in (1, 2) for p in range(3)] + [(1, s, p, p + 100 * s, "page_number") for s in (1, 2) for p in range(3, 20)]
    obs = spark.createDataFrame(rows, "source_id long, shard_ord long, page_idx long, printed long, kind string")
    segs = calibration.calibrated(obs)
    pages = obs.select("source_id", "shard_ord", "page_idx")
    got = {(r["shard_ord"], r["page_idx"]): r["locator"] for r in calibration.locators(pages, segs).collect()}
    assert got[(1, 0)] == "front-1-P1-s0" and got[(2, 0)] == "front-1-P2-s0" and got[(1, 5)] == "105"
