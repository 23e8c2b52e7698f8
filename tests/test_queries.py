"""Differential tests: every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import pytest

from quire.plans import registry
from tests.compare import same

WITHOUT_SQL = sorted(set(registry.QUERIES) - set(registry.ORACLES))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), registry.ORACLES[name], sf)


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(spark, sf, name):
    rows = registry.QUERIES[name](spark, sf)
    assert rows.columns and rows.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
