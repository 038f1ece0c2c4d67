"""Compares a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = SF_DIR):
    held = duckdb.connect()
    for name in TABLES:
        held.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return held


def same(df, con, sql: str) -> None:
    got = con.execute(sql)
    kinds = {c[0]: str(c[1]) for c in got.description}
    names = list(kinds)
    rows = got.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert {k: TYPES.get(v, v) for k, v in df.dtypes} == kinds
    order = sorted(names)
    want = sorted((tuple(r[names.index(c)] for c in order) for r in rows), key=repr)
    have = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    assert have == want
