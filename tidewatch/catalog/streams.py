"""Streaming queries: the tables are read as streams, run to the end, and the result is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.base import query
from tidewatch.catalog.features import _IMPORTANCE, shifted
from tidewatch.catalog.operations import LIMITS, _changes
from tidewatch.catalog.search import SLOTS
from tidewatch.catalog.views import (COMPLAINTS, CRM_CATEGORICAL, CRM_NUMERIC, EVENTS, INCOMING, RISK, complaints, crm, risk,
                                     usage_events, with_rule_category)
from tidewatch.functions import rules, text
from tidewatch.operators import actions, drift, embedding, playbook, usage
from tidewatch.session import scratch_path, stage
from tidewatch.sources.tables import table
from tidewatch.streaming import streams


def _events(spark, folder, bounded=True):
    raw = streams.table_stream(spark, folder, "events", bounded)
    usd = (F.rint(F.col("value") * 100).cast("bigint") / F.lit(10000.0)).cast("decimal(10,5)")
    return raw.select(
        F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("user_id").alias("visitor"),
        F.when(F.col("event_type") == "error", "failed").otherwise("answered").alias("outcome"), usd.alias("usd"),
        "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _backfill(spark, folder):
    """Lateness under which a table whose files come in any order loses no row: the time it spans."""
    days = table(spark, folder, "events", "ts").agg(F.datediff(F.max("ts"), F.min("ts"))).first()[0]
    return f"{(days or 0) + 2} days"


def _updated(spark, df, name, keys):
    path = scratch_path(spark, name)
    streams.run_available(streams.per_batch(df, path, mode="update"))
    return streams.newest(spark, path, df.schema, keys)


@query("stream_daily_usage", f"""WITH {EVENTS} SELECT CAST(date_trunc('day', "at") AS TIMESTAMP) AS window_start, visitor,
count(*) AS questions, CAST(sum(usd) AS DOUBLE) AS usd FROM ev WHERE outcome <> 'failed' GROUP BY 1, 2""")
def stream_daily_usage(spark, folder):
    """Questions and dollars per day and visitor from the event stream."""
    out = _updated(spark, streams.daily_usage(_events(spark, folder), _backfill(spark, folder)), "daily", ["window_start", "visitor"])
    return out.withColumn("usd", F.col("usd").cast("double"))


@query("stream_daily_usage_late", f"""WITH {EVENTS} SELECT CAST(date_trunc('day', "at") AS TIMESTAMP) AS window_start, visitor,
count(*) AS questions, CAST(sum(usd) AS DOUBLE) AS usd FROM ev WHERE outcome <> 'failed' GROUP BY 1, 2""")
def stream_daily_usage_late(spark, folder):
    """The same with a lateness of two days, so that state is let go, over files that are not in the order of time:
    what the stream dropped comes from the table of late rows."""
    source = scratch_path(spark, "unordered-events")
    events = usage_events(spark, folder).select("id", "at", "visitor", "outcome", "usd").filter(usage.counted())
    events.repartition(4, "id").write.parquet(source)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    arriving = streams.folder_stream(spark, source, events.schema)
    kept, side = scratch_path(spark, "daily-kept"), scratch_path(spark, "daily-late")
    live = streams.daily_usage(arriving, "2 days")
    streams.run_available(streams.per_batch(live, kept, mode="update"), late="count")
    streams.run_available(streams.per_batch(arriving, side, streams.late_rows(side, schema, "at", "1 day", "2 days")))
    late = streams.late_table(spark, side, schema)
    aside = late.groupBy(F.date_trunc("DAY", "at").cast("timestamp_ntz").alias("window_start"), "visitor").agg(
        F.count(F.lit(1)).alias("questions"), F.sum("usd").alias("usd"))
    both = streams.newest(spark, kept, live.schema, ["window_start", "visitor"]).select(*aside.columns).unionByName(aside)
    return both.groupBy("window_start", "visitor").agg(
        F.sum("questions").alias("questions"), F.sum("usd").cast("double").alias("usd"))


@query("stream_monthly_usage", f"""WITH {EVENTS} SELECT CAST(date_trunc('month', "at") AS TIMESTAMP) AS month,
count(*) AS questions, CAST(sum(usd) AS DOUBLE) AS usd FROM ev WHERE outcome <> 'failed' GROUP BY 1""")
def stream_monthly_usage(spark, folder):
    out = _updated(spark, streams.monthly_usage(_events(spark, folder), _backfill(spark, folder)), "monthly", ["month"])
    return out.withColumn("usd", F.col("usd").cast("double"))


@query("stream_sliding_hour", f"""WITH {EVENTS}, s AS (SELECT visitor, unnest(generate_series(
    time_bucket(INTERVAL 5 MINUTE, "at") - INTERVAL 55 MINUTE, time_bucket(INTERVAL 5 MINUTE, "at"), INTERVAL 5 MINUTE)) AS window_start
  FROM ev WHERE outcome <> 'failed')
SELECT window_start, visitor, count(*) AS questions FROM s GROUP BY 1, 2""")
def stream_sliding_hour(spark, folder):
    """Questions per visitor in every sliding hour."""
    steps = _updated(spark, streams.sliding_hour(_events(spark, folder), _backfill(spark, folder)), "hour",
                     ["window_start", "visitor"])
    return streams.hours(steps)


@query("stream_telemetry", f"""WITH {EVENTS} SELECT CAST(date_trunc('minute', "at") AS TIMESTAMP) AS window_start, event_type,
count(*) AS requests, round(sum(value), 4) AS total, max(value) AS largest FROM ev GROUP BY 1, 2""")
def stream_telemetry(spark, folder):
    """Requests and latency per minute and route."""
    out = _updated(spark, streams.route_telemetry(_events(spark, folder), "at", "event_type", "value",
                                                  lateness=_backfill(spark, folder)),
                   "telemetry", ["window_start", "event_type"])
    return out.withColumn("total", F.round("total", 4))


@query("stream_routing", f"""WITH {INCOMING}, r AS (SELECT *,
  len(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) < 8 AS short FROM incoming)
SELECT CASE WHEN short OR confidence < 0.6 THEN 'manual-triage' ELSE CASE category
    {" ".join(f"WHEN '{c}' THEN '{t}'" for c, t in rules.TEAMS.items())} END END AS team,
  CASE WHEN regexp_matches(text, '(?i)\\b({"|".join(text.URGENT_WORDS)})\\b') THEN 'urgent' ELSE 'normal' END AS priority,
  count(*) AS complaints FROM r GROUP BY 1, 2""")
def stream_routing(spark, folder):
    """Incoming messages classified, routed and logged as they arrive; the log is read back and counted."""
    messages = streams.table_stream(spark, folder, "conversations").filter("role = 'user'")
    routed = streams.route_complaints(messages, with_rule_category, customer=F.col("conv_id"))
    path = scratch_path(spark, "routing")
    streams.run_available(streams.per_batch(routed, path))
    log = actions.flatten_details(streams.batches(spark, path, routed.schema),
                                  {"team": "string", "priority": "string"}, prefix="")
    return log.groupBy("team", "priority").agg(F.count(F.lit(1)).alias("complaints"))


@query("stream_latency_quantile", f"""WITH {EVENTS} SELECT CAST(date_trunc('minute', "at") AS TIMESTAMP) AS window_start,
event_type, count(*) AS requests, TRUE AS within FROM ev GROUP BY 1, 2""")
def stream_latency_quantile(spark, folder):
    """The 95th percentile of latency per minute and route from sketches, and whether its rank among the values of
    the batch table is within the sketch's error."""
    out = _updated(spark, streams.route_quantiles(_events(spark, folder), "at", "event_type", "value",
                                                  lateness=_backfill(spark, folder)), "quantile", ["window_start", "event_type"])
    exact = table(spark, folder, "events", "ts", "event_type", "value").select(
        F.date_trunc("MINUTE", "ts").cast("timestamp_ntz").alias("window_start"), "event_type", "value")
    share = out.join(exact, ["window_start", "event_type"]).groupBy("window_start", "event_type").agg(
        F.max("requests").alias("requests"), F.avg((F.col("value") <= F.col("latency")).cast("double")).alias("upto"),
        F.avg((F.col("value") < F.col("latency")).cast("double")).alias("below"))
    low, high = streams.QUANTILE - streams.RANK_ERROR, streams.QUANTILE + streams.RANK_ERROR
    return share.select("window_start", "event_type", "requests",
                        ((F.col("upto") >= low) & (F.col("below") <= high)).alias("within"))


_BOTH = f"""{INCOMING}, {COMPLAINTS}, texts AS (SELECT 'c' || CAST(complaint_id AS VARCHAR) AS k, narrative AS t FROM cases
  UNION ALL SELECT 'q' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), text FROM incoming),
{SLOTS.replace("complaint_id", "k").replace("narrative", "t").replace("FROM cases", "FROM texts")}"""


@query("stream_similar_cases", f"""WITH {_BOTH},
dots AS (SELECT q.k AS q, c.k AS c, sum(q.weight * c.weight) AS score FROM slots q JOIN slots c USING (slot)
  WHERE q.k[1] = 'q' AND c.k[1] = 'c' GROUP BY 1, 2),
hits AS (SELECT conv_id, turn, complaint_id, row_number() OVER (PARTITION BY conv_id, turn
    ORDER BY round(coalesce(score, 0.0), 5) DESC, complaint_id) AS rank
  FROM incoming CROSS JOIN cases LEFT JOIN dots ON q = 'q' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)
    AND c = 'c' || CAST(complaint_id AS VARCHAR) QUALIFY rank <= 3)
SELECT conv_id, turn, string_agg(CAST(complaint_id AS VARCHAR) || ':' || cases.issue, ',' ORDER BY rank) AS similar
FROM hits JOIN cases USING (complaint_id) GROUP BY conv_id, turn""")
def stream_similar_cases(spark, folder):
    """Incoming messages routed with the three most similar documents, read back from the action log."""
    cases = complaints(spark, folder)
    index = stage(embedding.hashed_embedding(cases, "complaint_id", "narrative").join(
        cases.select("complaint_id", "issue"), "complaint_id").select(
        F.col("complaint_id").alias("id"), "embedding", "issue", F.lit(None).cast("string").alias("company_response")), "index")
    messages = streams.table_stream(spark, folder, "conversations").filter("role = 'user'")
    path = scratch_path(spark, "similar")
    step = streams.route_with_cases(index, with_rule_category, ["conv_id", "turn"], F.col("conv_id"))
    streams.run_available(streams.per_batch(messages, path, step))
    kind = messages.schema["conv_id"].dataType.simpleString(), messages.schema["turn"].dataType.simpleString()
    log = streams.batches(spark, path, f"conv_id {kind[0]}, turn {kind[1]}, action string, details string")
    found = actions.flatten_details(log.drop("action", streams.BATCH), {
        "similar_past_complaints": "array<struct<id:bigint,issue:string>>"}, prefix="")
    said = F.transform("similar_past_complaints", lambda c: F.concat_ws(":", c["id"].cast("string"), c["issue"]))
    return found.select("conv_id", "turn", F.array_join(said, ",").alias("similar"))


@query("stream_event_state", f"""WITH {EVENTS}, ch AS (
  SELECT id, "at" AS changed_at, 0 AS seq, 'pending' AS outcome, 0.05::DECIMAL(10, 5) AS usd FROM ev
  UNION ALL SELECT id, "at" + INTERVAL 5 SECOND, 1, outcome, CASE WHEN outcome = 'failed' THEN 0 ELSE usd END FROM ev
    WHERE k % 10 <> 0)
SELECT id, outcome, CAST(usd AS DOUBLE) AS usd FROM ch
QUALIFY row_number() OVER (PARTITION BY id ORDER BY changed_at DESC, seq DESC) = 1""")
def stream_event_state(spark, folder):
    """Reservations and settlements as they come; the state of every event lives in the stream."""
    live = streams.lifecycle(_changes(_events(spark, folder)))
    path = scratch_path(spark, "lifecycle")
    streams.run_available(streams.per_batch(live, path, mode="update"))
    state = streams.newest(spark, path, live.schema, ["id"])
    return state.select("id", "outcome", F.col("usd").cast("double").alias("usd"))


@query("stream_action_tail", """SELECT event_type AS action, count(*) AS n FROM events GROUP BY event_type""")
def stream_action_tail(spark, folder):
    """An action log tailed from JSON lines; repeated lines are kept once."""
    source, path = scratch_path(spark, "action-log"), scratch_path(spark, "action-tail")
    log = table(spark, folder, "events", "ts", "user_id", "event_type", "props", "event_id").select(
        F.col("ts").alias("logged_at"), F.col("user_id").cast("string").alias("customer_id"),
        F.col("event_type").alias("action"), F.lit("spark").alias("source"),
        F.to_json(F.struct("event_id", "props")).alias("details"))
    log.unionByName(log.filter("action = 'error'")).write.json(source)
    tail = streams.tail_actions(streams.action_stream(spark, source), "60 days")
    streams.run_available(streams.per_batch(tail, path))
    return actions.action_counts(streams.batches(spark, path, tail.schema))


@query("stream_drift_batches")
def stream_drift_batches(spark, folder):
    """Customer batches checked for drift as they arrive: the book as it is, then shifted."""
    book, source, path = stage(crm(spark, folder), "book"), scratch_path(spark, "books"), scratch_path(spark, "drift")
    profile = drift.build_profile(book, CRM_CATEGORICAL, CRM_NUMERIC)
    importances = spark.createDataFrame(list(_IMPORTANCE.items()), "feature string, importance double")
    step = streams.drift_check(profile, importances, CRM_CATEGORICAL, CRM_NUMERIC)
    for rows in (book, shifted(book).select(*book.columns)):
        rows.write.mode("append").parquet(source)
        arriving = streams.folder_stream(spark, source, book.schema, None)
        streams.run_available(streams.per_batch(arriving, path, step))
    return streams.batches(spark, path, streams.DRIFT_ROW).drop(streams.BATCH)


@query("stream_quota")
def stream_quota(spark, folder):
    """Quota decisions on the arriving events.  They depend on the order of arrival, so all that is there is taken
    as having arrived at once and is decided in the order of its times."""
    path = scratch_path(spark, "quota")
    streams.run_available(streams.per_batch(_events(spark, folder, False), path, streams.admit(path, LIMITS)))
    return streams.batches(spark, path, "id bigint, admitted boolean, reason string").drop(streams.BATCH)


@query("stream_retention", f"""WITH c AS (SELECT c_custkey, c_mktsegment,
  {RISK.format("c_acctbal")} AS p FROM customer)
SELECT CASE WHEN p >= 0.6 THEN 'retention_call' ELSE 'retention_email' END AS action,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '15% off for switching to a 1-year contract'
    ELSE 'loyalty check-in, no discount' END AS offer, count(*) AS customers FROM c WHERE p >= 0.35 GROUP BY 1, 2""")
def stream_retention(spark, folder):
    """Scheduled scoring run: customers that arrived are scored, tiered and logged as actions."""
    arriving = streams.table_stream(spark, folder, "customer")
    scored = arriving.withColumn("churn_probability", risk("c_acctbal")).withColumn(
        "tier", rules.risk_tier("churn_probability"))
    play = scored.withColumn("action", rules.tier_action("tier")).withColumn("offer", rules.retention_offer(
        "tier", F.col("c_mktsegment") == "BUILDING", F.lit(False), F.lit(False)))
    path = scratch_path(spark, "retention")
    log = playbook.playbook_actions(play, "c_custkey")
    streams.run_available(streams.per_batch(log, path))
    flat = actions.flatten_details(streams.batches(spark, path, log.schema), {"offer": "string"}, prefix="")
    return flat.groupBy("action", "offer").agg(F.count(F.lit(1)).alias("customers"))
