"""Usage metering over an event log (id, at, visitor, outcome, usd).

Failed events never count.  ``usd`` is decimal(10,5), so sums are exact.  Trailing and calendar totals are
prefix sums (see ordering.running): neither a busy day nor a heavy visitor has to fit one task.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.rules import PRICES, cost_nano, fits
from tidewatch.operators.ordering import running

USD = "decimal(10,5)"
HOUR = "INTERVAL 1 HOUR"
QUESTION_CHARS = 200


def counted() -> Column:
    return F.col("outcome") != "failed"


def day_of(ts: Column) -> Column:
    return F.date_trunc("DAY", ts).cast("timestamp_ntz")


def month_of(ts: Column) -> Column:
    return F.date_trunc("MONTH", ts).cast("timestamp_ntz")


def usage(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Per visitor active this month, as of an instant: own and global counters.

    One scan of the month: global figures are the sums of the per-visitor ones.
    """
    now = as_of if as_of is not None else events.agg(F.max("at")).scalar()
    at, usd = F.col("at"), F.col("usd")
    recent = events.filter(counted() & (at >= month_of(now)) & (at <= now))
    today, zero = at >= day_of(now), F.lit(0).cast("decimal(20,5)")
    per = recent.groupBy("visitor").agg(
        F.count_if(today).alias("visitor_day"),
        F.count_if(at >= now - F.expr(HOUR)).alias("visitor_hour"),
        F.coalesce(F.sum(F.when(today, usd)), zero).alias("usd_day"),
        F.coalesce(F.sum(usd), zero).alias("usd_all"))
    total = per.agg(F.struct(
        F.coalesce(F.sum("visitor_day"), F.lit(0)).alias("questions_today"),
        F.sum("usd_day").cast("double").alias("usd_today"),
        F.sum("usd_all").cast("double").alias("usd_month")).alias("t")).scalar()
    return per.select("visitor", total.alias("t"), "visitor_hour", "visitor_day").select(
        "visitor", "t.*", "visitor_hour", "visitor_day")


def visitor_counts_before(events: DataFrame, weight: Column) -> DataFrame:
    """Per event id: weighted count of the visitor's earlier events in the trailing hour and the same day.

    Every event asks two questions, "how many before me" and "how many before my window opened", as rows
    of the same ordered sequence; the difference of the two prefix sums is the windowed count.
    """
    at = F.col("at")
    asks = events.select("id", "visitor", weight.cast("int").alias("w"), F.explode(F.array(
        F.struct(at.alias("at"), F.lit(2).alias("kind")),
        F.struct((at - F.expr(HOUR)).alias("at"), F.lit(0).alias("kind")),
        F.struct(day_of(at).alias("at"), F.lit(1).alias("kind")))).alias("p")).select("id", "visitor", "w", "p.*")
    # at equal instants the window openings come first: the window includes its first instant
    own = F.when(F.col("kind") == 2, F.col("w")).otherwise(0)
    told = running(asks, ["visitor"], ["at", "kind", "id"], {"before": own}, name="visitor")
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("before")))
    return told.groupBy("id").agg(
        (pick(2) - pick(0)).alias("visitor_hour"), (pick(2) - pick(1)).alias("visitor_day"))


def global_before(events: DataFrame, weight: Column) -> DataFrame:
    """Per event id: weighted count and spend earlier the same day, spend earlier the same month."""
    w = weight.cast("int")
    rows = events.select("id", "at", day_of(F.col("at")).alias("day"), w.alias("w"),
                         F.when(weight, F.col("usd")).otherwise(F.lit(0).cast(USD)).alias("spent"))
    today = running(rows, ["day"], ["at", "id"],
                    {"questions_today": F.col("w"), "usd_today": F.col("spent")}, name="day")
    days = today.groupBy("day").agg(F.sum("spent").alias("spent"))
    earlier = Window.partitionBy(month_of(F.col("day"))).orderBy("day").rowsBetween(
        Window.unboundedPreceding, -1)
    # one row per calendar day
    months = days.select("day", F.coalesce(F.sum("spent").over(earlier), F.lit(0)).alias("month_before"))
    return today.join(F.broadcast(months), "day").select(
        "id", "questions_today", F.col("usd_today").cast("double").alias("usd_today"),
        (F.col("month_before") + F.col("usd_today")).cast("double").alias("usd_month"))


def usage_before(events: DataFrame, weight: Column | None = None) -> DataFrame:
    """The counters each event would have been checked against when it arrived."""
    weight = counted() if weight is None else weight
    return events.join(global_before(events, weight), "id").join(visitor_counts_before(events, weight), "id")


def price_table(spark, prices: Mapping[str, tuple] = PRICES) -> DataFrame:
    rows = [(m, *map(float, p)) for m, p in prices.items()]
    return spark.createDataFrame(
        rows, "model string, p_in double, p_out double, p_read double, p_write double")


def with_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per call (model, input_tokens, output_tokens, cache_read, cache_write), in dollars and in whole
    billionths of them.

    Unknown models are priced like the dearest row (largest price tuple).  The price list has one row
    per model on offer.
    """
    tuple_ = F.struct("p_in", "p_out", "p_read", "p_write")
    dearest = prices.agg(F.max(tuple_)).scalar()
    priced = calls.join(F.broadcast(prices.select("model", tuple_.alias("price"))), "model", "left")
    price = F.coalesce(F.col("price"), dearest)
    nano = cost_nano(F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read"), F.col("cache_write"), price)
    return priced.withColumn("nano", nano).withColumn("usd", F.col("nano") / F.lit(1e9)).drop("price")


def cost_totals(costed: DataFrame, by: list[str]) -> DataFrame:
    """Tokens (cache included on the input side) and dollars, exact to nine digits, per question, model, ..."""
    zero = F.lit(0)
    read, write = (F.coalesce(c, zero) for c in ("cache_read", "cache_write"))
    return costed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.col("input_tokens") + read + write).alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        (F.sum(F.col("nano").cast("decimal(18,0)")) * F.lit(Decimal("0.000000001"))).cast("decimal(38,9)").alias("usd"))


def quota_remaining(usage_rows: DataFrame, limits) -> DataFrame:
    """Questions left today overall and for each visitor; null where no limit is set."""
    # (who, limit, what counts against it, what one question takes)
    rules = [("all", limits.questions_per_day, "questions_today", 1),
             ("all", limits.usd_per_day, "usd_today", limits.usd_per_question),
             ("all", limits.usd_per_month, "usd_month", limits.usd_per_question),
             ("one", limits.visitor_per_hour, "visitor_hour", 1), ("one", limits.visitor_per_day, "visitor_day", 1)]

    def left(who: str) -> Column:
        rooms = [fits(limit, F.col(used), each) if used.startswith("usd") else F.lit(limit) - F.col(used)
                 for whose, limit, used, each in rules if whose == who and limit and each]
        # least() wants two columns at least, and skips nulls
        return F.greatest(F.least(*rooms, F.lit(None)), F.lit(0)).cast("bigint") if rooms else F.lit(None).cast("bigint")

    return usage_rows.select(
        "visitor", left("all").alias("remaining_today"), left("one").alias("remaining_for_you"),
        F.round("usd_today", 4).alias("spent_today_usd"), F.round("usd_month", 4).alias("spent_this_month_usd"))


def latest_state(changes: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """Current state per event from its change rows: a max_by, combined map-side."""
    order = order or ["changed_at", "seq"]
    others = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(
        F.max_by(F.struct(*others), F.struct(*order)).alias("state")).select(key, "state.*")


def event_row(visitor: Column, question: Column, reserve: float) -> list[Column]:
    """Columns of a freshly reserved event."""
    return [visitor.alias("visitor"), F.lit("pending").alias("outcome"),
            F.lit(reserve).cast(USD).alias("usd"), F.substring(question, 1, QUESTION_CHARS).alias("question")]
