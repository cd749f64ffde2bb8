"""The distributed replay equals the obvious loop, whatever path a visitor's requests take."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.quota import Limits, quota_replay
from tidewatch.operators.usage import quota_remaining, usage

START = dt.datetime(2024, 1, 30, 22, 0)
DDL = "id bigint, at timestamp_ntz, visitor bigint, outcome string, usd decimal(10,5)"


def loop(events, limits):
    """One request at a time against everything admitted before it."""
    kept, out = [], {}
    for id_, at, visitor, outcome, usd in sorted(events, key=lambda e: (e[1], e[0])):
        day = at.replace(hour=0, minute=0, second=0, microsecond=0)
        today = [k for k in kept if k[0] >= day]
        month = [k for k in kept if k[0] >= day.replace(day=1)]
        mine = [k for k in kept if k[1] == visitor]
        spent = lambda rows: float(sum(k[2] for k in rows))
        reason = None
        if limits.questions_per_day and len(today) >= limits.questions_per_day:
            reason = "questions_per_day"
        elif limits.usd_per_day and spent(today) + limits.usd_per_question > limits.usd_per_day + 1e-9:
            reason = "usd_per_day"
        elif limits.usd_per_month and spent(month) + limits.usd_per_question > limits.usd_per_month + 1e-9:
            reason = "usd_per_month"
        elif limits.visitor_per_hour and sum(
                k[0] >= at - dt.timedelta(hours=1) for k in mine) >= limits.visitor_per_hour:
            reason = "visitor_per_hour"
        elif limits.visitor_per_day and sum(k[0] >= day for k in mine) >= limits.visitor_per_day:
            reason = "visitor_per_day"
        out[id_] = reason
        if reason is None and outcome != "failed":
            kept.append((at, visitor, usd))
    return out


def traffic(n, seed, hours=60):
    """A third of the requests come from visitor 0; instants collide on purpose."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        visitor = 0 if rng.random() < 0.34 else rng.randrange(1, 12)
        at = START + dt.timedelta(minutes=rng.randrange(hours * 60))
        rows.append((i, at, visitor, "failed" if rng.random() < 0.15 else "answered",
                     Decimal(rng.randrange(1, 9)) / 100))
    return rows


CASES = [
    Limits(visitor_per_hour=2),
    Limits(visitor_per_hour=3, visitor_per_day=9),
    Limits(questions_per_day=40, visitor_per_hour=2, usd_per_question=0.05),
    Limits(questions_per_day=90, usd_per_day=3.0, usd_per_month=4.0, usd_per_question=0.05, visitor_per_hour=3,
           visitor_per_day=12),
    Limits(usd_per_day=1.0, usd_per_month=1.5, usd_per_question=0.05),
]


@pytest.mark.parametrize("limits", CASES)
def test_replay_equals_loop(spark, limits):
    rows = traffic(260, 7)
    got = {r["id"]: r["reason"] for r in quota_replay(spark.createDataFrame(rows, DDL), limits).collect()}
    assert got == loop(rows, limits)


@pytest.mark.parametrize("limits", CASES[1:3])
def test_long_runs_advance_hour_by_hour(spark, limits):
    """With a run limit of 0 rows every run takes the path for heavy visitors."""
    rows = traffic(120, 5, hours=5)
    got = {r["id"]: r["reason"] for r in quota_replay(spark.createDataFrame(rows, DDL), limits, run_rows=0).collect()}
    assert got == loop(rows, limits)


def _seq(spark, limits, visitors, outcome="answered", usd="0.02", n_failed=0):
    rows = [(i, START + dt.timedelta(minutes=i), v, "failed" if i < n_failed else outcome, Decimal(usd))
            for i, v in enumerate(visitors)]
    out = quota_replay(spark.createDataFrame(rows, DDL), limits).orderBy("id").collect()
    return [r["admitted"] for r in out]


def test_golden_sequences(spark):
    assert _seq(spark, Limits(questions_per_day=2), [1, 1, 1]) == [True, True, False]
    assert _seq(spark, Limits(usd_per_day=0.10, usd_per_question=0.05), [1] * 4) == [True, True, True, False]
    assert _seq(spark, Limits(visitor_per_hour=1), [1, 1, 2]) == [True, False, True]
    assert sum(_seq(spark, Limits(questions_per_day=5), [1] * 20)) == 5


def test_remaining(spark):
    at = START
    events = spark.createDataFrame([(1, at, 1, "failed", Decimal(0)), (2, at, 2, "answered", Decimal("0.06"))], DDL)
    now = usage(events, F.lit(str(at)).cast("timestamp_ntz"))
    left = quota_remaining(now, Limits(questions_per_day=2, visitor_per_hour=3)).first()
    assert (left["remaining_today"], left["remaining_for_you"], left["spent_today_usd"]) == (1, 2, 0.06)
    fresh = now.withColumn("usd_today", F.lit(0.0))
    # 0.50 / 0.05 is 9.99.. in floats
    assert quota_remaining(fresh, Limits(usd_per_day=0.5, usd_per_question=0.05)).first()["remaining_today"] == 10
    assert quota_remaining(now, Limits()).first()["remaining_today"] is None
