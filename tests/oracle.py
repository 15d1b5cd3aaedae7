"""Running a query beside its SQL: the same columns, row count and values."""

from __future__ import annotations

import math
import os

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in (t for t in TABLES if os.path.exists(f"{sf_dir}/{t}.parquet")):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def shown(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    return str(value)


def in_order(names: list[str], rows) -> list[tuple[str, ...]]:
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(shown(r[i]) for i in at) for r in rows)


def difference(df, sql: str, sf_dir: str = SF_DIR) -> str:
    """What differs; empty where nothing does."""
    names, rows = sql_rows(sql, sf_dir)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours, theirs = in_order(df.columns, df.collect()), in_order(names, rows)
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(wrong)} of {len(ours)} rows, first {wrong[0]}" if wrong else ""
