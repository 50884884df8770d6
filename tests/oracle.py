"""Compares a query with its SQL: columns, number of rows and values, in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if type(v).__name__ == "Decimal" else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows_of(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both give the same rows."""
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    theirs, ours = rows_of(names, got.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    if ours == theirs:
        return ""
    a, b = set(ours) - set(theirs), set(theirs) - set(ours)
    return f"{len(ours)} and {len(theirs)} rows; only here {sorted(a)[:2]}, only there {sorted(b)[:2]}"
