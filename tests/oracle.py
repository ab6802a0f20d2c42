"""Compares a Spark result with DuckDB's, as sorted rows with columns by name."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def duck(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(value):
    return int(value) if isinstance(value, float) and value == value and abs(value) < 1e15 and value == int(value) else value


def check(df, sql: str, sf_dir: str) -> int:
    names = sorted(df.columns)
    found = duck(sf_dir).sql(sql)
    kinds = dict(zip(found.columns, map(str, found.types), strict=True))
    assert sorted(found.columns) == names
    assert {n: KINDS[t] for n, t in df.dtypes} == kinds
    at = [list(found.columns).index(n) for n in names]
    want = sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
    got = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    assert got == want
    return len(got)
