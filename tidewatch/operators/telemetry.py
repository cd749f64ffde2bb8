"""Service telemetry: request rate and latency, probability histogram, gauges and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordering import running

BUCKETS = [i / 10 for i in range(1, 11)]


def route_latency(requests: DataFrame, ts: str, route: str, seconds: str, every: str = "1 minute",
                  quantile: float = 0.95, accuracy: int = 10_000) -> DataFrame:
    """Requests and latency quantile per window and route (mergeable sketch)."""
    return requests.groupBy(F.window(ts, every).alias("w"), route).agg(
        F.count(F.lit(1)).alias("requests"),
        F.percentile_approx(seconds, quantile, accuracy).alias("latency")).select(
        F.col("w.start").alias("window_start"), route, "requests", "latency")


def route_latency_exact(requests: DataFrame, ts: str, route: str, seconds: str, unit: str = "DAY",
                        quantile: float = 0.95) -> DataFrame:
    """As above with the exact nearest-rank quantile: values are collapsed, then ranked in two levels."""
    bucketed = requests.groupBy(F.date_trunc(unit, ts).cast("timestamp_ntz").alias("window_start"), route,
                                F.col(seconds).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    keys = ["window_start", route]
    ranked = running(bucketed, keys, ["v"], {"upto": F.col("n")}, inclusive=True, name="latency")
    totals = ranked.groupBy(*keys).agg(F.sum("n").alias("requests"))
    place = F.ceil(F.col("requests") * F.lit(quantile))
    return ranked.join(totals, keys).filter(F.col("upto") >= place).groupBy(*keys).agg(
        F.max("requests").alias("requests"), F.min("v").alias("latency"))


def cumulative_buckets(df: DataFrame, value: Column, bounds: list[float] | None = None) -> DataFrame:
    """Observations at or below each upper bound, plus the total: one aggregate, a row per bound."""
    bounds = bounds or BUCKETS
    one = df.agg(*[F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
                 F.count(value).alias("total"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("observations"))
                     for i, b in enumerate(bounds)])
    return one.select(F.explode(rows).alias("r"), "total").select("r.le", "r.observations", "total")


def gauge(df: DataFrame, ts: str, value: str, by: list[str], tie: str | None = None) -> DataFrame:
    """Last and largest value and the sum per label."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    return df.groupBy(*by).agg(
        F.max_by(value, order).alias("last_value"), F.max(value).alias("max_value"),
        F.count(F.lit(1)).alias("samples"))


def counter_increase(df: DataFrame, ts: str, by: str, labels: list[str] | None = None, unit: str = "DAY") -> DataFrame:
    """Events per unit and label, with the running total; labels without events are listed as 0.  The labels are
    those of the data unless given."""
    counts = df.groupBy(F.date_trunc(unit, ts).cast("timestamp_ntz").alias("window_start"), by).agg(
        F.count(F.lit(1)).alias("n"))
    known = F.array(*[F.lit(x) for x in labels]) if labels else counts.agg(F.collect_set(by)).scalar()
    grid = counts.select("window_start").distinct().withColumn("_known", known).select(
        "window_start", F.explode("_known").alias(by))
    filled = grid.join(counts, ["window_start", by], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    upto = Window.partitionBy(by).orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("total", F.sum("n").over(upto))
