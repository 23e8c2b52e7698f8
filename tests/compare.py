"""Spark rows against DuckDB rows of the same tables."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf: str) -> list[dict]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return [dict(zip(names, r, strict=True)) for r in got.fetchall()]


def told(rows: list[dict]) -> list[tuple]:
    return sorted(tuple(str(v) for _, v in sorted(r.items())) for r in rows)


def same(df, sql: str, sf: str) -> None:
    a, b = [r.asDict() for r in df.collect()], duck(sql, sf)
    if b:
        assert sorted(df.columns) == sorted(b[0])
    assert told(a) == told(b)
