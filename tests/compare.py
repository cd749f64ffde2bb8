"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}") + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, query, sql: str, folder: str) -> str | None:
    """None when equal, otherwise what differs."""
    df = query(spark, folder)
    ours = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} vs {sorted(columns)}"
    theirs = rows_of(columns, result.fetchall())
    if len(ours) != len(theirs):
        return f"{name}: {len(ours)} rows vs {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            bad = sum(x != y for x, y in zip(ours, theirs))
            return f"{name}: {bad}/{len(ours)} rows differ, first {str(a)[:400]} vs {str(b)[:400]}"
    return None
