"""Seeded, exact-count sampling, splits and folds over a unique row key.

Rows are ordered by ``md5(key || ':' || seed)``, which is the same on every run and every cluster.  The
first hex digits of that hash spread rows evenly, so the m-th row of the order is found by counting rows
per prefix and ranking inside the one prefix that holds it; the table itself is never sorted or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_DIGITS = 4          # 65,536 prefixes: the rank table stays a few MB per label


def shuffle_key(key: str | Column, seed: int | str) -> Column:
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(column.cast("string"), F.lit(f":{seed}")))


def _prefix_counts(hashed: DataFrame, by: list[str]) -> DataFrame:
    counts = hashed.groupBy(*by, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *by, "_prefix", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*by)).alias("_total"))


def hash_cutoff(df: DataFrame, key: str, seed: int | str, size: Column, by: list[str] | None = None) -> DataFrame:
    """The hash of the last row taken when ``size`` rows per ``by`` group are taken in hash order.

    ``size`` may use ``_total`` (rows in the group).  One row per group; groups with size 0 are absent.
    """
    by = by or []
    hashed = df.select(*by, shuffle_key(key, seed).alias("_hash")).withColumn(
        "_prefix", F.substring("_hash", 1, PREFIX_DIGITS))
    size = F.least(size.cast("long"), F.col("_total"))
    border = _prefix_counts(hashed, by).withColumn("_size", size).filter(
        (F.col("_before") < F.col("_size")) & (F.col("_size") <= F.col("_before") + F.col("_n")))
    inside = hashed.join(F.broadcast(border.select(*by, "_prefix", "_before", "_size")), [*by, "_prefix"])
    rank = F.row_number().over(Window.partitionBy(*by, "_prefix").orderBy("_hash"))
    return inside.withColumn("_rank", rank + F.col("_before")).filter(
        F.col("_rank") == F.col("_size")).select(*by, F.col("_hash").alias("_cutoff"))


def mark_first(df: DataFrame, key: str, seed: int | str, size: Column, flag: str,
               by: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Flag exactly ``size`` rows per group (among rows matching ``where``), chosen by hash order."""
    by = by or []
    eligible = df if where is None else df.filter(where)
    cutoff = hash_cutoff(eligible, key, seed, size, by)
    # Without groups the cutoff is one hash.  It is fetched once (eager), so every later use of the marked
    # rows is a plain comparison in the scan instead of another pass for the same value.
    limit = F.col("_cutoff") if by else F.lit(cutoff.agg(F.max("_cutoff")).first()[0])
    chosen = F.coalesce(shuffle_key(key, seed) <= limit, F.lit(False))
    if where is not None:
        chosen = chosen & F.coalesce(where, F.lit(False))
    joined = df.join(F.broadcast(cutoff), by, "left") if by else df
    return joined.withColumn(flag, chosen).select(*df.columns, flag)


def exact_sample(df: DataFrame, key: str, n: int, seed: int | str = 42) -> DataFrame:
    marked = mark_first(df, key, seed, F.lit(n), "_taken")
    return marked.filter("_taken").drop("_taken")


def hold_out(df: DataFrame, key: str, n: int, seed: int | str = 42, max_fraction: float = 0.5) -> DataFrame:
    """Add ``held_out``: the first ``n`` rows in hash order are evaluation queries, the rest the corpus."""
    size = F.least(F.lit(n).cast("long"), F.floor(F.col("_total") * F.lit(max_fraction)))
    return mark_first(df, key, seed, size, "held_out")


def stratified_split(df: DataFrame, key: str, label: str, train_fraction: float = 0.8,
                     seed: int | str = 42) -> DataFrame:
    size = F.floor(F.col("_total") * F.lit(train_fraction))
    marked = mark_first(df, key, seed, size, "_train", by=[label])
    return marked.withColumn("split", F.when(F.col("_train"), "train").otherwise("test")).drop("_train")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int | str = 42) -> DataFrame:
    """Add ``fold``: rows of each label dealt round-robin in hash order."""
    hashed = df.withColumn("_hash", shuffle_key(key, seed)).withColumn(
        "_prefix", F.substring("_hash", 1, PREFIX_DIGITS))
    offsets = _prefix_counts(hashed.select(label, "_prefix"), [label]).select(label, "_prefix", "_before")
    rank = F.row_number().over(Window.partitionBy(label, "_prefix").orderBy("_hash"))
    return hashed.withColumn("_rank", rank).join(F.broadcast(offsets), [label, "_prefix"]).withColumn(
        "fold", F.pmod(F.col("_rank") + F.col("_before") - 1, F.lit(k)).cast("int")
    ).select(*df.columns, "fold")


def dedup(df: DataFrame, keys: list[str], prefer: list[Column]) -> DataFrame:
    """One row per key: the one whose ``prefer`` tuple is largest (a map-side combinable aggregate)."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*prefer)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)
