"""Streams over several micro-batches agree with the batch operators."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import rows_of

from tidewatch.operators import quota
from tidewatch.session import scratch_path
from tidewatch.streaming import streams

DDL = "id bigint, at timestamp_ntz, visitor bigint, outcome string, usd decimal(10,5)"


@pytest.fixture(scope="module")
def log(spark):
    """Events written as two files in time order."""
    start = dt.datetime(2024, 3, 30, 20, 0)
    rows = [(i, start + dt.timedelta(minutes=4 * i), i % 3, "failed" if i % 7 == 0 else "answered", Decimal("0.03"))
            for i in range(120)]
    path = scratch_path(spark, "event-files")
    for part in range(2):
        spark.createDataFrame(rows[part * 60:(part + 1) * 60], DDL).coalesce(1).write.mode("append").parquet(path)
    return path, spark.createDataFrame(rows, DDL)


def test_quota_continues_across_batches(spark, log):
    path, events = log
    limits = quota.Limits(questions_per_day=25, usd_per_month=1.2, usd_per_question=0.05, visitor_per_hour=3)
    out = scratch_path(spark, "quota-test")
    streams.run_available(streams.per_batch(streams.folder_stream(spark, path, DDL), out, streams.admit(out, limits)))
    got = {r["id"]: r["reason"] for r in streams.batches(spark, out, "id bigint, reason string").collect()}
    assert got == {r["id"]: r["reason"] for r in quota.quota_replay(events, limits).collect()}


def test_daily_usage_over_batches(spark, log):
    path, events = log
    df = streams.daily_usage(streams.folder_stream(spark, path, DDL))
    out = scratch_path(spark, "daily-test")
    streams.run_available(streams.per_batch(df, out, mode="update"))
    got = {(r["window_start"], r["visitor"]): r["questions"]
           for r in streams.newest(spark, out, df.schema, ["window_start", "visitor"]).collect()}
    rows = events.filter("outcome <> 'failed'").groupBy(
        F.date_trunc("DAY", "at").cast("timestamp_ntz").alias("d"), "visitor").count().collect()
    assert got == {(r["d"], r["visitor"]): r["count"] for r in rows}


def test_restart_does_not_repeat_batches(spark, log):
    path, _ = log
    out = scratch_path(spark, "restart-test")
    for _ in range(2):
        streams.run_available(streams.per_batch(streams.folder_stream(spark, path, DDL), out))
    assert streams.batches(spark, out, DDL).count() == 120


CHANGES = "id bigint, changed_at timestamp, seq int, outcome string, usd decimal(10,5)"


def _file(spark, path, rows):
    spark.createDataFrame([(i, dt.datetime(2024, 5, 1) + dt.timedelta(seconds=at), seq, outcome, Decimal(usd))
                           for i, at, seq, outcome, usd in rows], CHANGES).coalesce(1).write.mode("append").parquet(path)


def _live(spark, out, df):
    return {r["id"]: (r["outcome"], float(r["usd"])) for r in streams.newest(spark, out, df.schema, ["id"]).collect()}


def test_lifecycle_over_batches_and_restarts(spark):
    path, out = scratch_path(spark, "changes-in"), scratch_path(spark, "lifecycle-test")
    files = [[(1, 0, 0, "pending", "0.05"), (2, 0, 0, "pending", "0.05"), (3, 9, 1, "answered", "0.01")],
             [(1, 5, 1, "answered", "0.02"), (3, 0, 0, "pending", "0.05"), (4, 0, 0, "pending", "0.05")],
             [(4, 5, 1, "failed", "0"), (1, 5, 1, "answered", "0.02"), (1, 2, 0, "pending", "0.09")]]
    for rows in files:                  # each is a new run that goes on from the state of the one before
        _file(spark, path, rows)
        live = streams.lifecycle(streams.folder_stream(spark, path, CHANGES))
        streams.run_available(streams.per_batch(live, out, mode="update"))
    assert _live(spark, out, live) == {1: ("answered", 0.02), 2: ("pending", 0.05), 3: ("answered", 0.01), 4: ("failed", 0.0)}


def test_state_without_timers_calls_no_python_per_key(spark):
    path, out = scratch_path(spark, "changes-in"), scratch_path(spark, "lifecycle-many")
    _file(spark, path, [(i, at, at, outcome, "0.05") for i in range(300) for at, outcome in ((0, "pending"), (5, "answered"))])
    live = streams.lifecycle(streams.folder_stream(spark, path, CHANGES))
    assert "Pandas" not in live._jdf.queryExecution().logical().toString()
    streams.run_available(streams.per_batch(live, out, mode="update"))
    assert _live(spark, out, live) == {i: ("answered", 0.05) for i in range(300)}


def test_pending_events_expire(spark):
    path, out = scratch_path(spark, "changes-in"), scratch_path(spark, "expiry-test")
    for rows in ([(1, 0, 0, "pending", "0.05"), (2, 0, 0, "pending", "0.05")], [(1, 5, 1, "answered", "0.02")],
                 [(3, 100, 0, "pending", "0.05")], [(4, 130, 0, "pending", "0.05")], [(5, 135, 0, "pending", "0.05")]):
        _file(spark, path, rows)
        live = streams.lifecycle(streams.folder_stream(spark, path, CHANGES), patience=60, lateness="10 seconds")
        streams.run_available(streams.per_batch(live, out, mode="update"))
    got = _live(spark, out, live)
    assert got[1] == ("answered", 0.02) and got[2] == ("expired", 0.0) and got[3][0] == got[5][0] == "pending"


def test_sliding_hours_keep_one_state_per_step(spark, log):
    path, table = log
    live = streams.sliding_hour(streams.folder_stream(spark, path, table.schema), "10 days")
    out = scratch_path(spark, "hours")
    query = streams.per_batch(live, out, mode="update").trigger(availableNow=True).start()
    query.awaitTermination()
    counted = table.filter("outcome <> 'failed'")
    steps = counted.select(F.window("at", "5 minutes")["start"], "visitor").distinct().count()
    assert json.loads(query.recentProgress[-1].json)["stateOperators"][0]["numRowsTotal"] == steps
    got = streams.hours(streams.newest(spark, out, live.schema, ["window_start", "visitor"]))
    whole = counted.groupBy(F.window("at", "1 hour", "5 minutes")["start"].alias("window_start"), "visitor").agg(
        F.count(F.lit(1)).alias("questions"))
    assert rows_of(got.columns, got.collect()) == rows_of(whole.columns, whole.collect())


STREAMS = ["stream_daily_usage", "stream_monthly_usage", "stream_sliding_hour", "stream_telemetry", "stream_routing",
           "stream_event_state", "stream_retention", "stream_quota"]


@pytest.fixture(scope="module")
def parted(spark, folder, tmp_path_factory):
    """The streamed tables as folders of three files each, the newest rows first."""
    path = str(tmp_path_factory.mktemp("parted"))
    for name, order in (("events", "ts"), ("conversations", "conv_id"), ("customer", "c_custkey")):
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        cuts = [-1e18, *rows.select(F.unix_millis(F.col(order).cast("timestamp")).cast("double").alias("x") if order == "ts"
                                    else F.col(order).cast("double").alias("x")).approxQuantile("x", [0.33, 0.66], 0), 1e18]
        at = F.unix_millis(F.col(order).cast("timestamp")).cast("double") if order == "ts" else F.col(order).cast("double")
        for low, high in reversed(list(zip(cuts, cuts[1:]))):
            rows.filter((at > low) & (at <= high)).coalesce(1).write.mode("append").parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", STREAMS)
def test_folder_tables_in_any_order(spark, folder, parted, monkeypatch, name):
    query = entry.queries()[name]
    whole = rows_of(query(spark, folder).columns, query(spark, folder).collect())
    monkeypatch.setattr(streams, "FILES_PER_BATCH", 1)
    got = query(spark, parted)
    assert rows_of(got.columns, got.collect()) == whole and whole


def test_late_rows_are_reported(spark, tmp_path):
    start = dt.datetime(2024, 3, 30, 20, 0)
    for day in (9, 5, 0):
        spark.createDataFrame([(day, start + dt.timedelta(days=day), 1, "answered", Decimal("0.03"))], DDL).coalesce(
            1).write.mode("append").parquet(f"{tmp_path}/log")
    def writer():
        df = streams.daily_usage(streams.folder_stream(spark, f"{tmp_path}/log", DDL), "1 day")
        return streams.per_batch(df, scratch_path(spark, "late"), mode="update")
    assert streams.run_available(writer(), late="count") >= 1
    with pytest.raises(streams.LateRows):
        streams.run_available(writer())
