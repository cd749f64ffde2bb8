"""Structured Streaming jobs, each the continuous form of a batch operator.

Sinks are folders of micro-batches: batch ``n`` overwrites ``batch=n``, so a batch that is run again after
a failure replaces its own output and nothing else.  Aggregations run in update mode with a watermark; the
newest row per key of such a change log is the table a reader sees (``newest``).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from tidewatch.functions.rules import TEAMS
from tidewatch.operators import drift, embedding, quota, retrieval, routing
from tidewatch.operators.actions import ACTION
from tidewatch.operators.usage import HOUR, counted, month_of
from tidewatch.session import stage

BATCH = "batch"
FILES_PER_BATCH = 64        # of a backfill; a running stream sees few new files at a time


class LateRows(RuntimeError):
    """Rows came later than the stated lateness allows, so the result lacks them."""


# ------------------------------------------------------------------ sources and sinks

def table_stream(spark: SparkSession, folder: str, name: str, bounded: bool = True) -> DataFrame:
    """A warehouse table, one file or a growing folder of files, as a stream.

    A pattern that only the table's own name fits is taken for a file as well as for a folder.  Unless
    ``bounded`` is off, a micro-batch has at most ``FILES_PER_BATCH`` files.
    """
    path = f"{folder.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if bounded:
        reader = reader.option("maxFilesPerTrigger", FILES_PER_BATCH)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def folder_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = 1) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def action_stream(spark: SparkSession, path: str) -> DataFrame:
    """Tail of a JSON-lines action log."""
    return spark.readStream.schema(ACTION).json(path)


def per_batch(stream: DataFrame, path: str, step: Callable[[DataFrame, int], DataFrame] | None = None,
              mode: str = "append") -> DataStreamWriter:
    """Write every micro-batch (after ``step``) to its own folder below ``path``."""

    def write(rows: DataFrame, number: int) -> None:
        out = step(rows, number) if step else rows
        out.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_progress").foreachBatch(write)


def run_available(writer: DataStreamWriter, late: str = "raise") -> int:
    """Process everything there is, then stop; the number of rows (of an aggregation: of groups of a task's rows) that
    were too late to count.

    Such rows are missing from the result, so they are an error unless ``late`` is "count".
    """
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    dropped = sum(operator["numRowsDroppedByWatermark"] for progress in query.recentProgress
                  for operator in json.loads(progress.json)["stateOperators"])
    if dropped and late == "raise":
        raise LateRows(f"{dropped} rows were later than the lateness allows")
    return dropped


def batches(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """All written micro-batches (optionally only those before a number), with their number."""
    shape = schema if isinstance(schema, str) else ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = spark.read.schema(f"{shape}, {BATCH} bigint").option("pathGlobFilter", "*.parquet").parquet(path)
    return rows if before is None else rows.filter(F.col(BATCH) < before)


def newest(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """Current row per key of an update-mode change log."""
    rows = batches(spark, path, schema)
    others = [c for c in rows.columns if c not in (*keys, BATCH)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), BATCH).alias("_r")).select(*keys, "_r.*")


def late_rows(path: str, schema: str, ts: str, every: str, lateness: str) -> Callable[[DataFrame, int], DataFrame]:
    """Per-batch step that keeps what a windowed aggregation over the same micro-batches drops as too late.

    An aggregation drops a row whose window ended before the newest time of the batches up to the last but one,
    less the lateness.  Each batch therefore notes the newest time it has seen, in a row of its own, next to its late
    rows; ``late_table`` reads the latter back.
    """
    def step(rows: DataFrame, number: int) -> DataFrame:
        seen = rows.agg(F.max(_instant(ts)).alias("_seen"))
        marks = rows.limit(0).unionByName(seen, allowMissingColumns=True)
        if number < 2:
            return marks
        before = batches(rows.sparkSession, path, f"{schema}, _seen timestamp", before=number - 1).agg(F.max("_seen")).first()[0]
        if before is None:
            return marks
        border = F.lit(before) - F.expr(f"INTERVAL {lateness}")
        late = rows.filter(F.window(_instant(ts), every)["end"] <= border)
        return late.unionByName(marks, allowMissingColumns=True)

    return step


def late_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = batches(spark, path, f"{schema}, _seen timestamp")
    return rows.filter("_seen IS NULL").drop("_seen", BATCH)


def _instant(c: str) -> Column:
    return F.col(c).cast("timestamp")


def _start(windowed: DataFrame, *columns: str) -> DataFrame:
    return windowed.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *columns)


# ------------------------------------------------------------------ usage

def daily_usage(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Counted questions and dollars per day and visitor; sums over visitors give the global figures."""
    rows = events.withColumn("at", _instant("at")).filter(counted()).withWatermark("at", lateness)
    return _start(rows.groupBy(F.window("at", "1 day"), "visitor").agg(
        F.count(F.lit(1)).alias("questions"), F.sum("usd").alias("usd")), "visitor", "questions", "usd")


def monthly_usage(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    rows = events.withColumn("at", _instant("at")).filter(counted()).withWatermark("at", lateness)
    return rows.groupBy(F.date_trunc("MONTH", "at").cast("timestamp_ntz").alias("month")).agg(
        F.count(F.lit(1)).alias("questions"), F.sum("usd").alias("usd"))


def sliding_hour(events: DataFrame, lateness: str = "1 hour", step: str = "5 minutes") -> DataFrame:
    """Questions per visitor and step; ``hours`` makes the sliding hours of the newest ones.

    An event is in twelve windows but in one step, so the state is a twelfth of that of windows.  A step is needed for
    as long as the last window that it is in.
    """
    rows = events.withColumn("at", _instant("at")).filter(counted()).withWatermark("at", f"{lateness} 60 minutes")
    return _start(rows.groupBy(F.window("at", step), "visitor").agg(
        F.count(F.lit(1)).alias("questions")), "visitor", "questions")


def hours(steps: DataFrame, step: str = "5 minutes") -> DataFrame:
    """Questions per visitor in every sliding hour; coarser than the batch trailing hour by one step."""
    first = F.col("window_start") - F.expr("INTERVAL 1 HOUR") + F.expr(f"INTERVAL {step}")
    starts = F.explode(F.sequence(first, F.col("window_start"), F.expr(f"INTERVAL {step}")))
    return steps.select(starts.alias("window_start"), "visitor", "questions").groupBy("window_start", "visitor").agg(
        F.sum("questions").alias("questions"))


def route_telemetry(requests: DataFrame, ts: str, route: str, seconds: str, every: str = "1 minute",
                    lateness: str = "10 minutes") -> DataFrame:
    """Requests, total and largest latency per window and route."""
    rows = requests.withColumn(ts, _instant(ts)).withWatermark(ts, lateness)
    return _start(rows.groupBy(F.window(ts, every), route).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(seconds).alias("total"), F.max(seconds).alias("largest")),
        route, "requests", "total", "largest")


QUANTILE, RANK_ERROR = 0.95, 0.0133       # of a sketch with the default size of 200


def route_quantiles(requests: DataFrame, ts: str, route: str, seconds: str, every: str = "1 minute",
                    lateness: str = "10 minutes", quantile: float = QUANTILE) -> DataFrame:
    """Latency quantile per window and route from a mergeable sketch that is the stream's state; its rank is off by
    ``RANK_ERROR`` at most (with 99 % confidence), and by nothing while a window has fewer requests than the sketch."""
    rows = requests.withColumn(ts, _instant(ts)).withWatermark(ts, lateness)
    sketch = F.kll_sketch_agg_double(F.col(seconds).cast("double")).alias("sketch")
    sketched = rows.groupBy(F.window(ts, every), route).agg(F.count(F.lit(1)).alias("requests"), sketch)
    return _start(sketched.withColumn("latency", F.kll_sketch_get_quantile_double("sketch", F.lit(quantile))),
                  route, "requests", "latency")


# ------------------------------------------------------------------ event lifecycle

STATE = "changed_at timestamp, seq int, outcome string, usd decimal(10,5)"
LIVE = f"id bigint, {STATE}"
KEYED_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lifecycle(StatefulProcessor):
    """State of one event: reserved (pending), then settled or released by a later change.

    Changes may come in any order; the newest one counts.  An event that is still pending ``patience`` seconds after
    its reservation expires and costs nothing; a change that settles it afterwards still counts, being newer.
    """

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get()
        newest = before = tuple(held) if held is not None else None
        for frame in rows:
            for row in zip(frame["changed_at"], frame["seq"], frame["outcome"], frame["usd"]):
                if newest is None or (row[0], row[1]) > (newest[0], newest[1]):
                    newest = (row[0].to_pydatetime(), int(row[1]), row[2], row[3])
        if newest == before:
            return
        self.state.update(newest)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if newest[2] == "pending":
            self.handle.registerTimer(int(newest[0].timestamp() * 1000) + self.patience * 1000)
        yield self._row(key, newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.state.get()
        if held is None or held[2] != "pending":
            return
        at = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        lapsed = (at, int(held[1]) + 1, "expired", Decimal(0))
        self.state.update(lapsed)
        yield self._row(key, lapsed)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, state):
        return pd.DataFrame({"id": [key[0]], "changed_at": [state[0]], "seq": [state[1]], "outcome": [state[2]],
                             "usd": [state[3]]})


def lifecycle(changes: DataFrame, patience: int | None = None, lateness: str = "1 day") -> DataFrame:
    """Every new state of every event (id, changed_at, seq, outcome, usd), kept per key in the stream's own state.

    Without a ``patience`` nothing expires, no watermark is needed and a change may come at any time.  The state is then
    the largest change of the key, kept by an aggregation, and no key costs a call of Python; an event whose changes in a
    batch are older than its state shows that state again.  Of changes of one time and ``seq`` the largest outcome, then
    the largest cost counts.
    """
    rows = changes.select(F.col("id").cast("bigint").alias("id"), _instant("changed_at").alias("changed_at"),
                          F.col("seq").cast("int").alias("seq"), "outcome", F.col("usd").cast("decimal(10,5)").alias("usd"))
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", KEYED_STATE)
    if patience is None:
        newest_change = F.max(F.struct("changed_at", "seq", "outcome", "usd")).alias("_r")
        return rows.groupBy("id").agg(newest_change).select("id", "_r.*")
    return rows.withWatermark("changed_at", lateness).groupBy("id").transformWithStateInPandas(
        Lifecycle(patience), LIVE, "Update", "EventTime")


# ------------------------------------------------------------------ workflows

def route_complaints(messages: DataFrame, classify: Callable[[DataFrame], DataFrame],
                     teams: dict[str, str] | None = None, customer: Column | None = None) -> DataFrame:
    """Classify, route and turn every incoming complaint into an action row (stateless)."""
    routed = routing.route(classify(messages), teams=teams or TEAMS)
    return routing.routed_actions(routed, F.col("customer_id") if customer is None else customer)


def route_with_cases(index: DataFrame, classify: Callable[[DataFrame], DataFrame], key: list[str], customer: Column,
                     k: int = 3, text: str = "text") -> Callable[[DataFrame, int], DataFrame]:
    """Per-batch step: each arriving complaint is classified and routed, its ``k`` most similar cases are looked up
    in a stored ``index`` (id, embedding, issue, company_response) of hashed embeddings, and the action row lists them."""

    def step(rows: DataFrame, number: int) -> DataFrame:
        asked = stage(rows.withColumn("_ask", F.monotonically_increasing_id()), "asked")
        vectors = stage(embedding.hashed_embedding(asked, "_ask", text), "asked-vectors")
        hits = retrieval.knn(vectors.withColumnRenamed("_ask", "id"), index.select("id", "embedding"), k, digits=5)
        cases = hits.join(index.select("id", "issue", "company_response"), "id").groupBy(
            F.col("query_id").alias("_ask")).agg(F.array_sort(F.collect_list(F.struct(       # k at most
                "rank", "id", "issue", "company_response", F.round("score", 4).alias("similarity")))).alias("_found"))
        listed = F.transform("_found", lambda c: F.struct(
            c["id"].alias("id"), c["issue"].alias("issue"), c["company_response"].alias("company_response"),
            c["similarity"].alias("similarity")))
        routed = routing.route(classify(asked).join(cases.select("_ask", listed.alias("similar")), "_ask", "left"))
        return routing.routed_actions(routed, customer, similar="similar", keep=key)

    return step


def tail_actions(actions: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Log rows, each once: repeats inside the watermark are dropped, rows later than it as well."""
    keyed = actions.withWatermark("logged_at", lateness)
    return keyed.dropDuplicatesWithinWatermark(["logged_at", "customer_id", "action", "details"])


def drift_check(profile: DataFrame, importances: DataFrame, categorical: list[str],
                numeric: list[str]) -> Callable[[DataFrame, int], DataFrame]:
    """Per-batch step: the drift verdict and what follows from it; too small a batch is only noted."""

    def step(rows: DataFrame, number: int) -> DataFrame:
        rows.persist()
        try:
            n = rows.count()
            empty = (F.lit(number).cast("bigint").alias("checked_batch"), F.lit(n).alias("customers"))
            if n < drift.MIN_BATCH:
                spark = rows.sparkSession
                return spark.range(1).select(
                    *empty, F.lit("batch_too_small").alias("action"), F.lit("").alias("drifted_features"),
                    F.lit(0.0).alias("drifted_importance_mass"))
            psi = drift.feature_psi(profile, rows, categorical, numeric)
            verdict = drift.drift_verdict(psi, importances, n)
            follow = F.when(F.col("retrain_recommended"), "retrain").otherwise("drift_check_healthy")
            out = verdict.select(*empty, follow.alias("action"),
                                 F.array_join("drifted_features", ",").alias("drifted_features"),
                                 "drifted_importance_mass")
            return out.sparkSession.createDataFrame(out.collect(), out.schema)      # one row
        finally:
            rows.unpersist()

    return step


DRIFT_ROW = ("checked_batch bigint, customers bigint, action string, drifted_features string, "
             "drifted_importance_mass double")


def admit(path: str, limits: quota.Limits, id_type: str = "bigint",
          visitor_type: str = "bigint") -> Callable[[DataFrame, int], DataFrame]:
    """Per-batch step: quota decisions that continue from the batches already written to ``path``.

    Replaying what was admitted earlier this month together with the new rows reproduces the earlier
    decisions, and the quotas themselves bound that history.  A row that arrives late is decided as of the
    newest decision, never before it.
    """
    schema = f"id {id_type}, visitor {visitor_type}, at timestamp_ntz, usd decimal(10,5), outcome string, " \
             "admitted boolean, reason string"

    def step(rows: DataFrame, number: int) -> DataFrame:
        new = rows.select("id", "visitor", "at", "usd", "outcome")
        events = new
        if number > 0:
            done = batches(rows.sparkSession, path, schema, before=number).filter("admitted").filter(counted())
            latest = done.agg(F.max("at")).scalar()
            new = new.withColumn("at", F.greatest("at", latest))
            since = F.coalesce(month_of(latest), F.lit("1970-01-01").cast("timestamp_ntz"))
            history = done.filter(F.col("at") >= since - F.expr(HOUR)).select(*new.columns)
            events = history.unionByName(new)
        decided = quota.quota_replay(events, limits).select("id", "admitted", "reason")
        return new.join(decided, "id").select("id", "visitor", "at", "usd", "outcome", "admitted", "reason")

    return step
