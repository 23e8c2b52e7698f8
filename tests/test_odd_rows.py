"""Queries against their SQL on rows that the small tables don't have."""

from __future__ import annotations

import shutil

import duckdb
import pytest

from quire.plans import registry
from tests.compare import same

#: Sections enough for a book of more than 999.
SECTIONS = 1005
DOCUMENTS = ["  ", "", " lead and trail \n x\t\n\ty\n\n  \nz ", "\n".join(f"line {i} of many" for i in range(1300)), "a \nb　\nq\r\nend"]


@pytest.fixture(scope="module")
def odd(sf, tmp_path_factory):
    """The small tables with documents of blanks, of blanks around lines and of many lines, and pages with references cut short."""
    to = tmp_path_factory.mktemp("odd")
    shutil.copytree(sf, to, dirs_exist_ok=True, copy_function=shutil.copyfile)
    con = duckdb.connect()
    con.execute(f"CREATE TABLE d AS SELECT * FROM '{sf}/documents.parquet'")
    con.executemany("INSERT INTO d VALUES (?, ?, 'en', 'web', ?)", [(100001 + k, t, len(t)) for k, t in enumerate(DOCUMENTS)])
    con.execute(f"CREATE TABLE p AS SELECT * FROM '{sf}/pages.parquet'")
    con.execute("INSERT INTO p SELECT 100001, url, regexp_replace(html, '<h1>.*?</h1>', '<h1>A &amp;&amp;&amp</h1>') FROM p WHERE page_id = 1")
    con.execute("INSERT INTO p SELECT 100002, url, regexp_replace(html, '<h1>.*?</h1>', '<h1>A &lt;b&quot</h1>') FROM p WHERE page_id = 2")
    con.execute(f"INSERT INTO d SELECT 200000 + 50 * k, 'section', 'en', 'web', 7 FROM range({SECTIONS}) t(k)")
    (to / "documents.parquet").unlink()
    (to / "pages.parquet").unlink()
    con.execute(f"COPY p TO '{to}/pages.parquet'")
    con.execute(f"COPY d TO '{to}/documents.parquet'")
    return str(to)


@pytest.mark.parametrize("name", ["a21_fidelity", "f28_human_sizes", "k05_stale_files", "s09_contents_of_books", "s10_spines_of_books", "s02_raw_items", "a16_html_counters", "w21_whole_paragraphs", "x03_html_items", "x06_html_blocks"])
def test_matches_sql(spark, odd, name):
    same(registry.QUERIES[name](spark, odd), registry.ORACLES[name], odd)
