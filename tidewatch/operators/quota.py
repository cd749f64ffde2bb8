"""Quota admission replay: which requests would have been let through.

Requests are taken in (at, id) order and checked against what was admitted before them: questions and
dollars today, dollars this month, the visitor's last hour and day.  Refused and failed requests do not
count.  The replay is sequential by definition, but only through very little state, which is what lets it
run distributed:

* a global limit, once exhausted, stays exhausted until its day or month ends, so it amounts to one cut
  row per period, found with prefix sums;
* a visitor's limits only couple requests of one *run* (consecutive busy hours).  Runs with fewer requests
  than the limits are admitted as they are; short runs are walked in order inside a task; long runs (one
  visitor may send a third of everything) advance hour by hour for all visitors at once, needing only
  conditional counts and row positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordering import running
from tidewatch.operators.usage import HOUR, counted, day_of, month_of, usage_before
from tidewatch.session import stage

# a run of at most this many counted requests is walked by one task
RUN_ROWS = 200_000
_EPSILON = 1e-9


@dataclass(frozen=True)
class Limits:
    """0 switches a limit off."""

    questions_per_day: int = 0
    usd_per_day: float = 0.0
    usd_per_month: float = 0.0
    usd_per_question: float = 0.0
    visitor_per_hour: int = 0
    visitor_per_day: int = 0

    @property
    def for_everyone(self) -> bool:
        return bool(self.questions_per_day or self.usd_per_day or self.usd_per_month)

    @property
    def for_visitors(self) -> bool:
        return bool(self.visitor_per_hour or self.visitor_per_day)


def _hour_of(ts: Column) -> Column:
    return F.date_trunc("HOUR", ts).cast("timestamp_ntz")


def _runs(requests: DataFrame, limits: Limits) -> DataFrame:
    """(visitor, hour, run, run_rows): consecutive busy hours; with a daily limit a run also spans the day."""
    hours = requests.groupBy("visitor", "hour").agg(F.count(F.lit(1)).alias("n"))
    by_visitor = Window.partitionBy("visitor").orderBy("hour")      # rows: busy hours of the log
    last = F.lag("hour").over(by_visitor)
    apart = last.isNull()
    if limits.visitor_per_hour and limits.visitor_per_day:
        apart = apart | ((F.col("hour") > last + F.expr(HOUR)) & (day_of(F.col("hour")) != day_of(last)))
    elif limits.visitor_per_hour:
        apart = apart | (F.col("hour") > last + F.expr(HOUR))
    else:
        apart = apart | (day_of(F.col("hour")) != day_of(last))
    numbered = hours.withColumn("opens", apart.cast("int")).withColumn(
        "run", F.sum("opens").over(by_visitor))
    return numbered.select("visitor", "hour", "run", F.sum("n").over(
        Window.partitionBy("visitor", "run")).alias("run_rows"))


def _walk(limits: Limits):
    """Admit rows sorted by (visitor, run, at, id); state carries across Arrow batches."""
    per_hour, per_day = limits.visitor_per_hour, limits.visitor_per_day
    hour, day_us = np.int64(3_600_000_000), np.int64(86_400_000_000)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, day, today, kept = None, None, 0, []
        for batch in batches:
            take = np.zeros(len(batch), dtype=bool)
            rows = zip(batch["visitor"].to_numpy(), batch["run"].to_numpy(), batch["us"].to_numpy())
            for i, (visitor, number, us) in enumerate(rows):
                if (visitor, number) != run:
                    run, day, today, kept = (visitor, number), None, 0, []
                if us // day_us != day:
                    day, today = us // day_us, 0
                if per_hour:
                    while kept and kept[0] < us - hour:
                        kept.pop(0)
                    if len(kept) >= per_hour:
                        continue
                if per_day and today >= per_day:
                    continue
                take[i] = True
                today += 1
                if per_hour:
                    kept.append(us)
            yield batch.loc[take, ["id"]]

    return walk


def _advance_hours(requests: DataFrame, limits: Limits) -> DataFrame:
    """Ids admitted from long runs, hour by hour, with no task seeing more than its share of an hour.

    Within a clock hour an admitted request blocks its slot to the end of that hour.  With the slots'
    release times in order, the k-th admission is the first row that is past both the k-th release and
    the admission before it; as row positions that is max over j <= k of (rows up to release j) + k - j.
    """
    width = limits.visitor_per_hour or limits.visitor_per_day
    placed = running(requests.select("visitor", "hour", "at", "id"), ["visitor", "hour"], ["at", "id"],
                     {"pos": F.lit(1)}, name="long-runs")
    placed = stage(placed, "long-runs-by-hour", partition_by=["hour"])
    hours = [r["hour"] for r in placed.select("hour").distinct().orderBy("hour").collect()]
    state, admitted = None, []
    for hour in hours:
        at_hour = F.lit(str(hour)).cast("timestamp_ntz")
        rows = placed.filter(F.col("hour") == at_hour).drop("hour")
        if state is None:
            held = rows.withColumn("releases", F.array().cast("array<timestamp_ntz>")).withColumn(
                "used", F.lit(0).cast("bigint"))
        else:
            same_day = F.col("state_day") == day_of(at_hour)
            fresh = F.filter("kept", lambda a: a + F.expr(HOUR) >= at_hour)
            known = state.select("visitor", F.array_sort(F.transform(
                fresh, lambda a: a + F.expr(HOUR))).alias("releases"),
                F.when(same_day, F.col("used")).otherwise(F.lit(0)).alias("used"))
            held = rows.join(known, "visitor", "left").withColumns({
                "releases": F.coalesce("releases", F.array().cast("array<timestamp_ntz>")),
                "used": F.coalesce("used", F.lit(0))})
        passed = [F.count_if(F.col("at") <= F.try_element_at("releases", F.lit(j + 1))) for j in range(width)]
        counts = held.groupBy("visitor").agg(
            F.max("releases").alias("releases"), F.max("used").alias("used"),
            F.count(F.lit(1)).alias("n"), F.array(*passed).alias("passed"))
        free = F.lit(width) - F.size("releases")
        slots = counts.withColumn("ranks", F.concat(
            F.array_repeat(F.lit(0).cast("bigint"), free), F.slice("passed", 1, F.size("releases"))))
        order = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.array_max(F.transform(
            F.slice("ranks", 1, k + 1), lambda r, j: r + k - j)))
        allowed = F.lit(width).cast("bigint")
        if limits.visitor_per_day:
            allowed = F.least(allowed, F.greatest(F.lit(limits.visitor_per_day) - F.col("used"), F.lit(0)))
        picks = slots.select("visitor", "used", F.slice(F.filter(
            order, lambda p: p < F.col("n")), 1, allowed.cast("int")).alias("picks"))
        taken = stage(rows.join(picks, "visitor").filter(F.array_contains("picks", F.col("pos"))).select(
            "visitor", "id", "at", "used"), "long-run-hour")
        admitted.append(taken.select("id"))
        # at most `width` instants per long-run visitor
        now = taken.groupBy("visitor").agg(
            F.collect_list("at").alias("kept"), (F.max("used") + F.count(F.lit(1))).alias("used"))
        now = now.withColumn("state_day", day_of(at_hour))
        if state is not None:
            idle = state.join(now, "visitor", "left_anti").filter(F.col("state_day") == day_of(at_hour))
            now = now.unionByName(idle)
        state = stage(now, "long-run-state")
    out = admitted[0]
    for more in admitted[1:]:
        out = out.unionByName(more)
    return out


def _visitor_admitted(requests: DataFrame, limits: Limits, run_rows: int) -> DataFrame:
    """Requests (counted ones) that pass the visitor limits alone."""
    if not limits.for_visitors:
        return requests
    if not limits.visitor_per_hour:
        # a daily limit alone is a position within (visitor, day)
        placed = running(requests.withColumn("day", day_of(F.col("at"))), ["visitor", "day"], ["at", "id"],
                         {"pos": F.lit(1)}, name="visitor-day")
        return placed.filter(F.col("pos") < limits.visitor_per_day).drop("pos", "day")
    tagged = requests.withColumn("hour", _hour_of(F.col("at")))
    tagged = stage(tagged.join(_runs(tagged, limits), ["visitor", "hour"]), "runs")
    smallest = min(x for x in (limits.visitor_per_hour, limits.visitor_per_day) if x)
    free = tagged.filter(F.col("run_rows") <= smallest).select("id")
    short = tagged.filter((F.col("run_rows") > smallest) & (F.col("run_rows") <= run_rows))
    walked = short.select("visitor", "run", "id", F.unix_micros(F.col("at").cast("timestamp")).alias("us")
                          ).repartition("visitor", "run").sortWithinPartitions("visitor", "run", "us", "id")
    schema = f"id {dict(requests.dtypes)['id']}"
    ids = free.unionByName(walked.mapInPandas(_walk(limits), schema))
    long_runs = tagged.filter(F.col("run_rows") > run_rows)
    if not long_runs.isEmpty():
        ids = ids.unionByName(_advance_hours(long_runs, limits))
    return requests.join(ids, "id", "left_semi")


def _cuts(admitted: DataFrame, limits: Limits) -> list[tuple]:
    """Last row that fits, per exhausted day and month: (period, 'day'|'month', at, id), a row per period."""
    rows = admitted.withColumn("day", day_of(F.col("at")))
    summed = running(rows, ["day"], ["at", "id"], {"n": F.lit(1), "spent": F.col("usd")}, inclusive=True,
                     name="cuts")
    full = F.lit(False)
    if limits.questions_per_day:
        full = full | (F.col("n") >= limits.questions_per_day)
    if limits.usd_per_day:
        full = full | (F.col("spent").cast("double") + limits.usd_per_question > limits.usd_per_day + _EPSILON)
    place = F.struct("at", "id")
    daily = summed.groupBy("day").agg(F.min(F.when(full, place)).alias("cut"))
    cuts = [(r["day"], "day", r["cut"]["at"], r["cut"]["id"]) for r in daily.filter("cut is not null").collect()]
    if limits.usd_per_month:
        inside = summed.join(F.broadcast(daily), "day").filter(F.col("cut").isNull() | (place <= F.col("cut")))
        totals = inside.groupBy("day").agg(F.max("spent").alias("total"))
        earlier = Window.partitionBy(month_of(F.col("day"))).orderBy("day").rowsBetween(
            Window.unboundedPreceding, -1)
        prior = totals.select("day", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("prior"))
        over = inside.join(F.broadcast(prior), "day").filter(
            (F.col("prior") + F.col("spent")).cast("double") + limits.usd_per_question
            > limits.usd_per_month + _EPSILON)
        monthly = over.groupBy(month_of(F.col("day")).alias("month")).agg(F.min(place).alias("cut"))
        cuts += [(r["month"], "month", r["cut"]["at"], r["cut"]["id"]) for r in monthly.collect()]
    return sorted(cuts)


def _keep_before(requests: DataFrame, cuts: list[tuple], id_type: str) -> DataFrame:
    if not cuts:
        return requests
    spark = requests.sparkSession
    table = spark.createDataFrame(
        cuts, f"period timestamp_ntz, kind string, cut_at timestamp_ntz, cut_id {id_type}")
    out = requests
    for kind, period in (("day", day_of), ("month", month_of)):
        one = table.filter(F.col("kind") == kind).select(
            F.col("period").alias(f"_{kind}"), F.struct(
                F.col("cut_at").alias("at"), F.col("cut_id").alias("id")).alias("_cut"))
        out = out.withColumn(f"_{kind}", period(F.col("at"))).join(F.broadcast(one), f"_{kind}", "left").filter(
            F.col("_cut").isNull() | (F.struct("at", "id") <= F.col("_cut"))).drop("_cut", f"_{kind}")
    return out


def admitted_requests(events: DataFrame, limits: Limits, run_rows: int = RUN_ROWS) -> DataFrame:
    """Counted requests that get through."""
    requests = events.filter(counted()).select("id", "at", "visitor", "usd")
    reserve = limits.usd_per_question
    if any(b and reserve > b + _EPSILON for b in (limits.usd_per_day, limits.usd_per_month)):
        return requests.limit(0)
    if not limits.for_everyone:
        return _visitor_admitted(requests, limits, run_rows)
    id_type = dict(requests.dtypes)["id"]
    cuts: list[tuple] = []
    while True:
        through = stage(_visitor_admitted(_keep_before(requests, cuts, id_type), limits, run_rows), "admitted")
        found = _cuts(through, limits)
        # A cut frees the trailing hour after it, which can only change later days; the first day is
        # right after one round, so this ends, and a fixed point is the one consistent replay.
        if found == cuts or not limits.visitor_per_hour:
            return _keep_before(through, found, id_type)
        cuts = found


def refusal_reason(limits: Limits) -> Column:
    """First limit, in check order, that the counters violate; null means admitted."""
    reserve = limits.usd_per_question
    checks = []
    if limits.questions_per_day:
        checks.append((F.col("questions_today") >= limits.questions_per_day, "questions_per_day"))
    if limits.usd_per_day:
        checks.append((F.col("usd_today") + reserve > limits.usd_per_day + _EPSILON, "usd_per_day"))
    if limits.usd_per_month:
        checks.append((F.col("usd_month") + reserve > limits.usd_per_month + _EPSILON, "usd_per_month"))
    if limits.visitor_per_hour:
        checks.append((F.col("visitor_hour") >= limits.visitor_per_hour, "visitor_per_hour"))
    if limits.visitor_per_day:
        checks.append((F.col("visitor_day") >= limits.visitor_per_day, "visitor_per_day"))
    reason = F.lit(None).cast("string")
    for broken, name in reversed(checks):
        reason = F.when(broken, F.lit(name)).otherwise(reason)
    return reason


def quota_replay(events: DataFrame, limits: Limits, run_rows: int = RUN_ROWS) -> DataFrame:
    """(id, visitor, at, admitted, reason) for every event, failed ones included (they are only checked)."""
    let_in = stage(admitted_requests(events, limits, run_rows).select("id").withColumn("_in", F.lit(True)), "let-in")
    flagged = events.join(let_in, "id", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    seen = usage_before(flagged, F.col("_in"))
    return seen.withColumn("reason", refusal_reason(limits)).select(
        "id", "visitor", "at", F.col("reason").isNull().alias("admitted"), "reason")
