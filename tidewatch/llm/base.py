"""Registry of the queries here, and helpers that several operators use."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import prepare
from tidewatch.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

__all__ = ["QUERIES", "SQL", "query", "table", "without", "utf8", "runs", "extended", "sha_hex"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that gives the same rows where there is one."""
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepare(spark), folder)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return register


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add; names are compared as Spark compares them."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def extended(schema: T.StructType, **fields: str) -> T.StructType:
    """``schema`` with fields of the given DDL types behind it."""
    out = T.StructType(list(schema.fields))
    for name, kind in fields.items():
        out = out.add(name, T._parse_datatype_string(kind) if isinstance(kind, str) else kind)
    return out


def utf8(column: str | Column = "text") -> Column:
    """Bytes of a text; those of no text are none."""
    return F.coalesce(F.encode(F.col(column) if isinstance(column, str) else column, "UTF-8"), F.lit(b""))


def sha_hex(column: Column) -> Column:
    return F.sha2(column, 256)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal ``keys`` in batches that arrive sorted by them, one table per group.

    Only the group at hand is held, so a partition may hold any number of groups.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*[batch.column(k).to_pylist() for k in keys]))
        start = 0
        for i, value in enumerate(values):
            if value != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    group, held = pa.Table.from_batches(held), []
                    yield group
                    del group               # before the next one is gathered
                start, last = i, value
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
