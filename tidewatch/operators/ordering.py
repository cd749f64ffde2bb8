"""Order-dependent operators that never put one key into one task.

A plain ``Window.partitionBy(key).orderBy(..)`` sends every row of a key to one task.  Keys here may hold
a third of all rows (a busy day, one heavy visitor, the negative class), so running totals are computed in
two levels instead: the rows are *range*-partitioned by (key, order), each partition is summed on its own,
and the few keys that cross a partition border get the sum of their earlier partitions added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import stage

POSITION = "_position"
_PART = "_part"


def positioned(df: DataFrame, order: list[str | Column], name: str = "ordered") -> DataFrame:
    """``df`` in global order, with the number of its partition and a number that ascends inside it.

    The result is written out, so the partition border of a row is the same for every later reader.
    ``order`` should be (nearly) unique: equal keys cannot be told apart by a range partitioner.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ordered.withColumn(_PART, F.spark_partition_id()).withColumn(
        POSITION, F.monotonically_increasing_id()), name)


def running(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column],
            inclusive: bool = False, name: str = "running") -> DataFrame:
    """Add, per row, the running sum of each expression over the earlier rows of the same keys."""
    return running_over(positioned(df, [*keys, *order], name), keys, sums, inclusive)


def running_over(placed: DataFrame, keys: list[str], sums: dict[str, Column], inclusive: bool = False) -> DataFrame:
    """``running`` over rows already ``positioned`` by (keys, order)."""
    columns = [c for c in placed.columns if c not in (POSITION, _PART)]
    group = [*keys, _PART]
    totals = placed.groupBy(*group).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    # (key, partition) pairs: one per key plus one per border crossed, so a key has few rows here
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *group, *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        F.lag(_PART).over(Window.partitionBy(*keys).orderBy(_PART)).alias("_prev"),
    ).filter(F.col("_prev").isNotNull()).drop("_prev")
    # at most one row per partition border, because keys are contiguous in the order
    inside = Window.partitionBy(*group).orderBy(POSITION).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    here = placed.select("*", *[F.sum(e).over(inside).alias(f"_i_{n}") for n, e in sums.items()])
    carried = here.alias("h").join(
        F.broadcast(carry).alias("c"),
        [F.col(f"h.{k}").eqNullSafe(F.col(f"c.{k}")) for k in group], "left")
    zero = F.lit(0)
    return carried.select(
        *[F.col(f"h.{c}") for c in columns],
        *[(F.coalesce(F.col(f"h._i_{n}"), zero) + F.coalesce(F.col(f"c._c_{n}"), zero)).alias(n)
          for n in sums],
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int,
                rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key.  Spark keeps only k rows per key and map task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def exact_quantiles(df: DataFrame, key: str, value: str, probs: list[float]) -> tuple[DataFrame, DataFrame]:
    """Exact linear-interpolated quantiles of ``value`` per ``key`` at any number of distinct values.

    Returns ``(counts, edges)``: ``counts(key, value, n)`` is the pre-aggregated column (useful for
    histograms over the same data), ``edges(key, total, quantiles array)`` one row per key.
    """
    return quantiles_of_counts(df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n")), key, value, probs)


def quantiles_of_counts(counts: DataFrame, key: str, value: str, probs: list[float]) -> tuple[DataFrame, DataFrame]:
    """``exact_quantiles`` of values that come counted, as (key, value, n)."""
    placed = positioned(counts, [key, value], "quantiles")
    ranked = running_over(placed, [key], {"before": F.col("n")})
    totals = placed.groupBy(key).agg(F.sum("n").alias("total"))
    # keys are column names here, so `totals` has as many rows as the table has columns
    last = F.col("total") - 1
    slots = F.array_distinct(F.concat(*[F.array(F.floor(last * p), F.ceil(last * p)) for p in probs]))
    here = F.filter(slots, lambda s: (s >= F.col("before")) & (s < F.col("before") + F.col("n")))
    hits = ranked.join(F.broadcast(totals), key).select(key, "total", value, F.explode(here).alias("slot"))
    at = hits.groupBy(key).agg(F.max("total").alias("total"), F.map_from_entries(
        F.collect_list(F.struct("slot", value))).alias("at"))        # two slots per quantile at most

    def quantile(p: float) -> Column:
        low, high = F.col("at")[F.floor(last * p)], F.col("at")[F.ceil(last * p)]
        return F.when(low == high, low).otherwise(low + (high - low) * (last * p - F.floor(last * p)))

    edges = at.select(key, "total", F.array(*[quantile(float(p)) for p in probs]).alias("quantiles"))
    return placed.select(key, value, "n"), stage(edges, "edges")
