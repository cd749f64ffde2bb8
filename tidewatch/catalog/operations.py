"""Text rules, playbook, routing, usage metering, action log, telemetry, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.base import query
from tidewatch.catalog.views import (EVENTS, INCOMING, SCORED, complaints, incoming, price_values,
                                     scored_crm, usage_events)
from tidewatch.functions import rules, text
from tidewatch.operators import actions, playbook, quota, routing, telemetry, usage
from tidewatch.operators.cleaning import label_from
from tidewatch.session import scratch_path
from tidewatch.sources import records
from tidewatch.sources.tables import table

# ------------------------------------------------------------------ text

_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_TERM = "th"
_MASK = r"regexp_replace({0}, '(^|[^\p{{L}}\p{{N}}_])th[\p{{L}}\p{{N}}_]*', '\1', 'gi')"


@query("text_normalize", f"""SELECT doc_id,
{_SQUEEZE.format("regexp_replace(lower(text), '[^a-z]', ' ', 'g')")} AS normalized FROM documents""")
def text_normalize(spark, folder):
    return table(spark, folder, "documents", "doc_id", "text").select(
        "doc_id", text.normalize("text").alias("normalized"))


_MASKED = (r"trim(regexp_replace(regexp_replace(" + _MASK.format("text")
           + r", '\s+', ' ', 'g'), '\s+([.,])', '\1', 'g'))")


@query("mask_term", f"SELECT doc_id, {_MASKED} AS masked FROM documents")
def mask_term(spark, folder):
    """Remove every word starting with a term."""
    return table(spark, folder, "documents", "doc_id", "text").select(
        "doc_id", text.mask_term("text", _TERM).alias("masked"))


_SENTENCES = r"""parts AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'),
    '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS s FROM documents)"""
_DROPPED = "CASE WHEN len(s) <= 1 THEN '' ELSE " + _SQUEEZE.format(
    _MASK.format("array_to_string(s[1:len(s) - 1], ' ')")) + " END"


@query("drop_last_sentence", f"WITH {_SENTENCES} SELECT doc_id, {_DROPPED} AS kept FROM parts")
def drop_last_sentence(spark, folder):
    return table(spark, folder, "documents", "doc_id", "text").select(
        "doc_id", text.drop_last_sentence("text", _TERM).alias("kept"))


@query("leak_audit", f"""WITH {_SENTENCES}, a AS (
  SELECT contains(lower(text), 'th') AS before, contains(lower({_MASKED}), 'th') AS after, {_DROPPED} AS kept
  FROM documents JOIN parts USING (doc_id))
SELECT count(*) FILTER (WHERE before) AS mention_before, count(*) FILTER (WHERE after) AS mention_after,
       count(*) FILTER (WHERE kept = '') AS emptied, count(*) AS rows FROM a""")
def leak_audit(spark, folder):
    """Rows mentioning a term before and after masking, rows emptied by dropping the last sentence."""
    docs = table(spark, folder, "documents", "text")
    return docs.agg(
        F.count_if(text.mentions("text", _TERM)).alias("mention_before"),
        F.count_if(text.mentions(text.mask_term("text", _TERM), _TERM)).alias("mention_after"),
        F.count_if(text.drop_last_sentence("text", _TERM) == "").alias("emptied"), F.count(F.lit(1)).alias("rows"))


@query("text_measures", r"""SELECT doc_id,
  CAST(len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) AS INTEGER) AS words,
  CASE WHEN length(text) > 400 THEN substring(text, 1, 400) || '…' ELSE text END AS shown,
  regexp_matches(text, '(?i)\b(lawyer|attorney|lawsuit|sue|cfpb|fraud|identity theft|stolen)\b') AS urgent,
  text ILIKE '%license%' AS mentions_license FROM documents""")
def text_measures(spark, folder):
    """Word count, truncation with ellipsis, urgency words, case-insensitive containment."""
    return table(spark, folder, "documents", "doc_id", "text").select(
        "doc_id", text.word_count("text").alias("words"), text.truncate("text", 400, "…").alias("shown"),
        text.is_urgent("text").alias("urgent"), text.mentions("text", "license").alias("mentions_license"))


@query("pseudonyms", "SELECT event_id, substr(sha256('pepper:' || CAST(user_id AS VARCHAR)), 1, 16) AS visitor FROM events")
def pseudonyms(spark, folder):
    return table(spark, folder, "events", "event_id", "user_id").select(
        "event_id", text.pseudonym("user_id", "pepper").alias("visitor"))


# ------------------------------------------------------------------ playbook

_PLAYBOOK = f"""{SCORED},
tiered AS (SELECT *, CASE WHEN churn_probability >= 0.6 THEN 'high' WHEN churn_probability >= 0.35 THEN 'medium'
  ELSE 'low' END AS tier FROM scored),
play AS (SELECT customer, churn_probability, balance, tier,
  CASE tier WHEN 'high' THEN 'retention_call' WHEN 'medium' THEN 'retention_email' ELSE 'none' END AS action,
  CASE WHEN tier = 'low' THEN NULL WHEN segment = 'BUILDING' THEN '{rules.OFFER_CONTRACT}'
    WHEN urgent = 'No' AND orders > 0 THEN '{rules.OFFER_SUPPORT}' WHEN nation = 'NATION_7' THEN '{rules.OFFER_AUTOPAY}'
    ELSE '{rules.OFFER_DEFAULT}' END AS offer FROM tiered)"""


def _playbook(spark, folder):
    scored = scored_crm(spark, folder)
    tiered = scored.withColumn("tier", rules.risk_tier("churn_probability"))
    return tiered.select(
        "customer", "churn_probability", "balance", "tier", rules.tier_action("tier").alias("action"),
        rules.retention_offer("tier", F.col("segment") == "BUILDING",
                              (F.col("urgent") == "No") & (F.col("orders") > 0),
                              F.col("nation") == "NATION_7").alias("offer"))


@query("risk_tier_offer", f"WITH {_PLAYBOOK} SELECT customer, churn_probability, balance, tier, action, offer FROM play")
def risk_tier_offer(spark, folder):
    """Tier, action and offer per customer."""
    return _playbook(spark, folder)


_JOINED = f"""WITH {_PLAYBOOK}, pred AS (SELECT customer, churn_probability FROM scored
  UNION ALL SELECT -1, 0.9)
SELECT pred.customer, pred.churn_probability,
  CASE WHEN pred.churn_probability >= 0.6 THEN 'retention_call' WHEN pred.churn_probability >= 0.35
    THEN 'retention_email' ELSE 'none' END AS action,
  CASE WHEN pred.churn_probability < 0.35 THEN NULL WHEN crm.segment = 'BUILDING' THEN '{rules.OFFER_CONTRACT}'
    WHEN crm.urgent = 'No' AND crm.orders > 0 THEN '{rules.OFFER_SUPPORT}'
    WHEN crm.nation = 'NATION_7' THEN '{rules.OFFER_AUTOPAY}' ELSE '{rules.OFFER_DEFAULT}' END AS offer
FROM pred LEFT JOIN crm ON crm.customer = pred.customer"""


def _played(spark, folder, known_only):
    scored = scored_crm(spark, folder)
    unknown = spark.createDataFrame([(-1, 0.9)], "customer bigint, churn_probability double")
    predictions = scored.select("customer", "churn_probability").unionByName(unknown)
    book = scored.select("customer", "segment", "urgent", "orders", "nation")
    out = playbook.apply_playbook(
        predictions, book, "customer", F.col("segment") == "BUILDING",
        (F.col("urgent") == "No") & (F.col("orders") > 0), F.col("nation") == "NATION_7", known_only)
    return out.select("customer", "churn_probability", "action", "offer")


@query("playbook_join", _JOINED)
def playbook_join(spark, folder):
    """Predictions joined to the customer book; a prediction without a customer gets the default offer."""
    return _played(spark, folder, False)


@query("playbook_known", _JOINED.replace("LEFT JOIN crm", "JOIN crm"))
def playbook_known(spark, folder):
    """Predictions of known customers only."""
    return _played(spark, folder, True)


# contributions to the risk with fixed coefficients: coefficient x (value - usual value), per field
_COEFFICIENTS = {"balance": (-0.0002, 4500.0), "orders": (-0.05, 10.0), "nation": (0.01, 0.0)}
_IMPACTS = """impacts AS (SELECT c.customer, unnest([
    {'feature': 'balance', 'value': CAST(CAST(c.balance AS DECIMAL(12, 2)) AS VARCHAR), 'impact': -0.0002::DOUBLE * (c.balance - 4500.0::DOUBLE)},
    {'feature': 'orders', 'value': CAST(c.orders AS VARCHAR), 'impact': -0.05::DOUBLE * (c.orders - 10.0::DOUBLE)},
    {'feature': 'nation', 'value': c.nation, 'impact': 0.01::DOUBLE * (CAST(replace(c.nation, 'NATION_', '') AS DOUBLE) - 0.0::DOUBLE)}]) AS f
  FROM scored c),
ranked AS (SELECT customer, f.feature || ' = ' || f.value AS driver, f.impact AS impact, row_number() OVER (
    PARTITION BY customer ORDER BY f.impact DESC, f.feature) AS place FROM impacts WHERE f.impact > 0),
drivers AS (SELECT customer, string_agg(driver, ', ' ORDER BY place) AS drivers, round(max(impact), 4) AS strongest
  FROM ranked WHERE place <= 3 GROUP BY customer)"""


def _driven(spark, folder):
    """(customer, factors): the three fields that raise a customer's risk most."""
    number = {"balance": F.col("balance"), "orders": F.col("orders"),
              "nation": F.regexp_replace("nation", "NATION_", "").cast("double")}
    said = {"balance": F.col("balance").cast("decimal(12,2)"), "orders": F.col("orders"), "nation": F.col("nation")}
    impacts = F.array(*[F.struct(F.lit(f).alias("feature"), said[f].cast("string").alias("value"),
                                 (F.lit(a) * (number[f] - F.lit(usual))).alias("impact"))
                        for f, (a, usual) in _COEFFICIENTS.items()])
    return scored_crm(spark, folder).select("customer", rules.top_drivers(impacts, 3).alias("factors"))


@query("risk_drivers_fixed", f"""WITH {SCORED}, {_IMPACTS}
SELECT s.customer, coalesce(drivers, '') AS drivers, strongest FROM scored s LEFT JOIN drivers USING (customer)""")
def risk_drivers_fixed(spark, folder):
    """The three strongest positive contributions of every customer as text, under fixed coefficients."""
    return _driven(spark, folder).select(
        "customer", F.array_join(rules.driver_text("factors"), ", ").alias("drivers"),
        F.try_element_at("factors", F.lit(1))["impact"].alias("strongest"))


@query("retention_digest", f"""WITH {_PLAYBOOK}, {_IMPACTS}, top AS (SELECT * FROM play LEFT JOIN drivers USING (customer)
  WHERE tier = 'high' ORDER BY churn_probability DESC, customer LIMIT 5)
SELECT count(*) AS customers, count(*) FILTER (WHERE tier = 'high') AS high,
  count(*) FILTER (WHERE tier = 'medium') AS medium,
  round(coalesce(sum(balance) FILTER (WHERE tier <> 'low'), 0.0), 2) AS revenue_at_risk,
  (SELECT string_agg(printf('%s - %.0f%% - %s', CAST(customer AS VARCHAR), churn_probability * 100,
     coalesce(drivers, '') || ' -> ' || offer), '|' ORDER BY churn_probability DESC, customer) FROM top) AS top_customers FROM play""")
def retention_digest(spark, folder):
    """One row per run: tier counts, revenue at risk, the five riskiest customers with their drivers."""
    drivers = _driven(spark, folder).select("customer", rules.driver_text("factors").alias("drivers"))
    out = playbook.digest(_playbook(spark, folder).join(drivers, "customer"), "customer", "balance")
    return out.withColumn("revenue_at_risk", F.round("revenue_at_risk", 2)).withColumn(
        "top_customers", F.array_join("top_customers", "|"))


@query("at_risk_topk", f"""WITH {_PLAYBOOK} SELECT customer, churn_probability, tier AS risk_tier,
(SELECT count(*) FROM play WHERE churn_probability >= 0.5) AS matching
FROM play WHERE churn_probability >= 0.5 ORDER BY churn_probability DESC, customer LIMIT 25""")
def at_risk_topk(spark, folder):
    """The riskiest customers (a list is 25 long at most) with the number of matches."""
    scored = scored_crm(spark, folder).select("customer", "churn_probability")
    return playbook.at_risk(scored, "customer", limit=40)


@query("tier_counts", f"""WITH {_PLAYBOOK}, t(tier) AS (VALUES ('high'), ('medium'), ('low'))
SELECT t.tier, count(play.customer) AS customers FROM t LEFT JOIN play ON play.tier = t.tier GROUP BY t.tier""")
def tier_counts(spark, folder):
    return playbook.tier_counts(scored_crm(spark, folder))


@query("playbook_actions", f"""WITH {_PLAYBOOK} SELECT CAST(customer AS VARCHAR) AS customer_id, action, 'spark' AS source,
  churn_probability, offer FROM play WHERE action <> 'none'""")
def playbook_actions(spark, folder):
    """Action rows for high and medium tiers, read back out of their JSON details."""
    rows = playbook.playbook_actions(_playbook(spark, folder), "customer")
    return actions.flatten_details(rows, {"churn_probability": "double", "offer": "string"}, prefix="")


# ------------------------------------------------------------------ routing

_ROUTED = f"""{INCOMING},
routed AS (SELECT conv_id, turn, category, confidence, text,
  len(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) < 8 AS short,
  confidence < 0.6 AS unsure FROM incoming)"""
_TEAM = "CASE " + " ".join(f"WHEN category = '{c}' THEN '{t}'" for c, t in rules.TEAMS.items()) + " END"


@query("complaint_routing", f"""WITH {_ROUTED} SELECT conv_id, turn, category, confidence,
  CASE WHEN short OR unsure THEN 'manual-triage' ELSE {_TEAM} END AS team,
  CASE WHEN regexp_matches(text, '(?i)\\b({"|".join(text.URGENT_WORDS)})\\b') THEN 'urgent' ELSE 'normal' END AS priority,
  CASE WHEN short THEN 'too short to classify reliably (< 8 words)'
    WHEN unsure THEN 'low model confidence (' || CAST(confidence AS VARCHAR) || ')' ELSE 'auto-routed' END AS reason,
  substring(text, 1, 280) AS excerpt FROM routed""")
def complaint_routing(spark, folder):
    """Team, priority and reason of every incoming message."""
    return routing.route(incoming(spark, folder)).drop("text")


@query("routed_action_log", f"""WITH {_ROUTED} SELECT CAST(conv_id AS VARCHAR) AS customer_id, 'route_complaint' AS action,
  'spark' AS source, category AS details_category,
  CASE WHEN short OR unsure THEN 'manual-triage' ELSE {_TEAM} END AS details_team,
  CAST(0 AS INTEGER) AS similar FROM routed""")
def routed_action_log(spark, folder):
    rows = routing.routed_actions(routing.route(incoming(spark, folder)), F.col("conv_id"))
    flat = actions.flatten_details(rows, {"category": "string", "team": "string",
                                          "similar_past_complaints": "array<string>"})
    return flat.withColumn("similar", F.size("details_similar_past_complaints")).drop(
        "details_similar_past_complaints")


# ------------------------------------------------------------------ usage

_COUNTED = "ok AS (SELECT * FROM ev WHERE outcome <> 'failed')"


@query("usage_counters", f"""WITH {EVENTS}, {_COUNTED}, n AS (SELECT max("at") AS now FROM ev)
SELECT visitor,
  (SELECT count(*) FROM ok, n WHERE "at" >= date_trunc('day', now)) AS questions_today,
  (SELECT CAST(coalesce(sum(usd), 0) AS DOUBLE) FROM ok, n WHERE "at" >= date_trunc('day', now)) AS usd_today,
  (SELECT CAST(coalesce(sum(usd), 0) AS DOUBLE) FROM ok, n WHERE "at" >= date_trunc('month', now)) AS usd_month,
  count(*) FILTER (WHERE "at" >= now - INTERVAL 1 HOUR) AS visitor_hour,
  count(*) FILTER (WHERE "at" >= date_trunc('day', now)) AS visitor_day
FROM ok, n WHERE "at" >= date_trunc('month', now) GROUP BY visitor""")
def usage_counters(spark, folder):
    """Global and per-visitor usage as of the last event."""
    return usage.usage(usage_events(spark, folder))


@query("visitor_trailing_hour", f"""WITH {EVENTS}, {_COUNTED}
SELECT e.id, (SELECT count(*) FROM ok o WHERE o.visitor = e.visitor AND o.at >= e.at - INTERVAL 1 HOUR
    AND (o.at < e.at OR (o.at = e.at AND o.id < e.id))) AS visitor_hour,
  (SELECT count(*) FROM ok o WHERE o.visitor = e.visitor AND o.at >= date_trunc('day', e.at)
    AND (o.at < e.at OR (o.at = e.at AND o.id < e.id))) AS visitor_day FROM ev e""")
def visitor_trailing_hour(spark, folder):
    """For every event: the visitor's earlier counted events in the hour and the day before it."""
    return usage.visitor_counts_before(usage_events(spark, folder), usage.counted())


@query("running_usage", f"""WITH {EVENTS}, w AS (SELECT *, CASE WHEN outcome <> 'failed' THEN 1 ELSE 0 END AS n,
  CASE WHEN outcome <> 'failed' THEN usd ELSE 0 END AS spent FROM ev)
SELECT id,
  CAST(coalesce(sum(n) OVER (PARTITION BY date_trunc('day', "at") ORDER BY "at", id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS questions_today,
  CAST(coalesce(sum(spent) OVER (PARTITION BY date_trunc('day', "at") ORDER BY "at", id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS usd_today,
  CAST(coalesce(sum(spent) OVER (PARTITION BY date_trunc('month', "at") ORDER BY "at", id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS usd_month FROM w""")
def running_usage(spark, folder):
    """Calendar-day and calendar-month totals just before every event."""
    return usage.global_before(usage_events(spark, folder), usage.counted())


LIMITS = quota.Limits(questions_per_day=400, usd_per_day=40.0, usd_per_month=1000.0, usd_per_question=0.05,
                      visitor_per_hour=3, visitor_per_day=20)


@query("quota_remaining", f"""WITH {EVENTS}, {_COUNTED}, n AS (SELECT max("at") AS now FROM ev),
u AS (SELECT visitor,
  (SELECT count(*) FROM ok, n WHERE "at" >= date_trunc('day', now)) AS q,
  (SELECT CAST(coalesce(sum(usd), 0) AS DOUBLE) FROM ok, n WHERE "at" >= date_trunc('day', now)) AS d,
  (SELECT CAST(coalesce(sum(usd), 0) AS DOUBLE) FROM ok, n WHERE "at" >= date_trunc('month', now)) AS m,
  count(*) FILTER (WHERE "at" >= now - INTERVAL 1 HOUR) AS vh,
  count(*) FILTER (WHERE "at" >= date_trunc('day', now)) AS vd
  FROM ok, n WHERE "at" >= date_trunc('month', now) GROUP BY visitor)
SELECT visitor, CAST(greatest(least(400 - q, trunc(round((40.0::DOUBLE - d) / 0.05::DOUBLE, 6)),
    trunc(round((1000.0::DOUBLE - m) / 0.05::DOUBLE, 6))), 0) AS BIGINT) AS remaining_today,
  CAST(greatest(least(3 - vh, 20 - vd), 0) AS BIGINT) AS remaining_for_you,
  round(d, 4) AS spent_today_usd, round(m, 4) AS spent_this_month_usd FROM u""")
def quota_remaining(spark, folder):
    return usage.quota_remaining(usage.usage(usage_events(spark, folder)), LIMITS)


@query("quota_replay")
def quota_replay(spark, folder):
    """Which events would have been admitted under all limits together."""
    return quota.quota_replay(usage_events(spark, folder), LIMITS)


@query("quota_replay_daily", f"""WITH {EVENTS}, d AS (SELECT *, row_number() OVER (
    PARTITION BY visitor, date_trunc('day', "at") ORDER BY "at", id) AS rn FROM ev WHERE outcome <> 'failed'),
kept AS (SELECT * FROM d WHERE rn <= 1),
g AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('day', "at") ORDER BY "at", id) AS n FROM kept),
adm AS (SELECT * FROM g WHERE n <= 50),
c AS (SELECT e.id, e.visitor, e."at",
  (SELECT count(*) FROM adm a WHERE a.at >= date_trunc('day', e.at) AND (a.at < e.at OR (a.at = e.at AND a.id < e.id))) AS q,
  (SELECT count(*) FROM adm a WHERE a.visitor = e.visitor AND a.at >= date_trunc('day', e.at)
     AND (a.at < e.at OR (a.at = e.at AND a.id < e.id))) AS v FROM ev e)
SELECT id, visitor, "at", q < 50 AND v < 1 AS admitted,
  CASE WHEN q >= 50 THEN 'questions_per_day' WHEN v >= 1 THEN 'visitor_per_day' END AS reason FROM c""")
def quota_replay_daily(spark, folder):
    """Replay under daily limits only (50 questions in all, 1 per visitor), which SQL can state."""
    return quota.quota_replay(usage_events(spark, folder), quota.Limits(questions_per_day=50, visitor_per_day=1))


_MODELS = [*rules.PRICES, "unlisted-model"]
_CALLS = f"""{EVENTS}, calls AS (SELECT id, visitor,
    CASE k % {len(_MODELS)} {" ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MODELS))} END AS model,
    k * 100 AS input_tokens, CAST(round(value * 100) AS BIGINT) AS output_tokens,
    CASE WHEN k % 2 = 0 THEN k * 10 END AS cache_read, CASE WHEN k % 3 = 0 THEN k * 7 END AS cache_write FROM ev),
prices(model, p_in, p_out, p_read, p_write) AS (VALUES {price_values()}),
top AS (SELECT * FROM prices ORDER BY p_in DESC, p_out DESC, p_read DESC, p_write DESC LIMIT 1),
cost AS (SELECT c.*, CAST(input_tokens * round(coalesce(p.p_in, t.p_in) * 1000)
    + output_tokens * round(coalesce(p.p_out, t.p_out) * 1000)
    + coalesce(cache_read, 0) * round(coalesce(p.p_read, t.p_read) * 1000)
    + coalesce(cache_write, 0) * round(coalesce(p.p_write, t.p_write) * 1000) AS BIGINT) AS nano, nano / 1e9 AS usd
  FROM calls c LEFT JOIN prices p USING (model), top t)"""


def _calls(spark, folder):
    names = F.array(*[F.lit(m) for m in _MODELS])
    k = F.col("k")
    return usage_events(spark, folder).select(
        "id", "visitor", F.element_at(names, k % len(_MODELS) + 1).alias("model"),
        (k * 100).alias("input_tokens"), F.rint(F.col("value") * 100).cast("bigint").alias("output_tokens"),
        F.when(k % 2 == 0, k * 10).alias("cache_read"), F.when(k % 3 == 0, k * 7).alias("cache_write"))


@query("call_cost", f"WITH {_CALLS} SELECT id, model, round(usd, 9) AS usd FROM cost")
def call_cost(spark, folder):
    """Cost per model call; unlisted models at the dearest price, missing cache counts as 0."""
    costed = usage.with_cost(_calls(spark, folder), usage.price_table(spark))
    return costed.select("id", "model", F.round("usd", 9).alias("usd"))


_EXACT = "CAST(round(CAST(sum(nano) AS DECIMAL(28, 0)) * 0.000000001::DECIMAL(10, 9), 6) AS DOUBLE) AS usd"


@query("cost_totals", f"""WITH {_CALLS} SELECT model, count(*) AS calls,
  CAST(sum(input_tokens + coalesce(cache_read, 0) + coalesce(cache_write, 0)) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, {_EXACT} FROM cost GROUP BY model""")
def cost_totals(spark, folder):
    costed = usage.with_cost(_calls(spark, folder), usage.price_table(spark))
    return usage.cost_totals(costed, ["model"]).withColumn("usd", F.round("usd", 6).cast("double"))


@query("cost_per_question", f"""WITH {_CALLS} SELECT id // 4 AS question, count(*) AS calls,
  CAST(sum(input_tokens + coalesce(cache_read, 0) + coalesce(cache_write, 0)) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, {_EXACT} FROM cost GROUP BY id // 4""")
def cost_per_question(spark, folder):
    """Tokens and dollars of every question, which takes several model calls (four here)."""
    calls = _calls(spark, folder).withColumn("question", F.expr("id DIV 4"))
    costed = usage.with_cost(calls, usage.price_table(spark))
    return usage.cost_totals(costed, ["question"]).withColumn("usd", F.round("usd", 6).cast("double"))


@query("event_latest_state", f"""WITH {EVENTS}, ch AS (
  SELECT id, "at" AS changed_at, 0 AS seq, 'pending' AS outcome, 0.05::DECIMAL(10, 5) AS usd FROM ev
  UNION ALL SELECT id, "at" + INTERVAL 5 SECOND, 1, outcome, CASE WHEN outcome = 'failed' THEN 0 ELSE usd END FROM ev
    WHERE k % 10 <> 0)
SELECT id, changed_at, seq, outcome, CAST(usd AS DOUBLE) AS usd FROM ch
QUALIFY row_number() OVER (PARTITION BY id ORDER BY changed_at DESC, seq DESC) = 1""")
def event_latest_state(spark, folder):
    """Reserved, then settled or released: the current state of every event."""
    state = usage.latest_state(_changes(usage_events(spark, folder)))
    return state.select("id", "changed_at", "seq", "outcome", F.col("usd").cast("double").alias("usd"))


def _changes(events):
    """Change rows: every event reserves its worst case; all but a tenth settle five seconds later."""
    pending = events.select("id", F.col("at").alias("changed_at"), F.lit(0).alias("seq"),
                            F.lit("pending").alias("outcome"), F.lit(0.05).cast(usage.USD).alias("usd"))
    settled = events.filter(F.col("k") % 10 != 0).select(
        "id", (F.col("at") + F.expr("INTERVAL 5 SECOND")).alias("changed_at"), F.lit(1).alias("seq"), "outcome",
        F.when(usage.counted(), F.col("usd")).otherwise(F.lit(0).cast(usage.USD)).alias("usd"))
    return pending.unionByName(settled)


# ------------------------------------------------------------------ action log

def _log(spark, folder):
    return table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "props").select(
        F.col("ts").alias("logged_at"), "event_id", F.col("user_id").cast("string").alias("customer_id"),
        F.col("event_type").alias("action"), F.lit("spark").alias("source"), F.col("props").alias("details"))


@query("action_counts", "SELECT event_type AS action, count(*) AS n FROM events GROUP BY event_type")
def action_counts(spark, folder):
    return actions.action_counts(_log(spark, folder))


@query("action_recent", """WITH newest AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)
SELECT event_id, ts AS logged_at, event_type AS action FROM newest WHERE event_type = 'purchase'
ORDER BY ts DESC, event_id DESC LIMIT 20""")
def action_recent(spark, folder):
    """Newest 20 rows of one action among the newest thousand."""
    rows = actions.recent_actions(_log(spark, folder), 20, "purchase",
                                  [F.col("logged_at").desc(), F.col("event_id").desc()], actions.SCAN_ROWS)
    return rows.select("event_id", "logged_at", "action")


@query("action_recent_all", """SELECT event_id, ts AS logged_at, event_type AS action FROM events
WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20""")
def action_recent_all(spark, folder):
    """Newest 20 rows of one action, however far back they are."""
    rows = actions.recent_actions(_log(spark, folder), 20, "error",
                                  [F.col("logged_at").desc(), F.col("event_id").desc()])
    return rows.select("event_id", "logged_at", "action")


@query("action_flatten", """SELECT ts AS logged_at, event_id, CAST(user_id AS VARCHAR) AS customer_id,
event_type AS action, 'spark' AS source, CAST(json_extract_string(props, '$.k') AS INTEGER) AS details_k FROM events""")
def action_flatten(spark, folder):
    """Fields of the JSON details as columns."""
    return actions.flatten_details(_log(spark, folder), {"k": "int"})


@query("action_log_round_trip", """SELECT event_type AS action, count(*) AS n, count(DISTINCT user_id) AS customers,
CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS k FROM events GROUP BY event_type""")
def action_log_round_trip(spark, folder):
    """Append the events to a JSON-lines action log, read the log back and summarise it."""
    path = scratch_path(spark, "actions")
    actions.append_actions(_log(spark, folder).drop("logged_at", "event_id"), path)
    log = actions.flatten_details(actions.read_actions(spark, path), {"k": "int"}, prefix="")
    per = log.groupBy("action", "customer_id").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))
    return per.groupBy("action").agg(F.sum("n").alias("n"), F.count("customer_id").alias("customers"),
                                     F.sum("k").alias("k"))


# ------------------------------------------------------------------ telemetry


@query("route_latency", """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS requests,
quantile_disc(value, 0.95) AS latency FROM events GROUP BY 1, 2""")
def route_latency(spark, folder):
    """Requests and exact p95 per route and day."""
    return telemetry.route_latency_exact(table(spark, folder, "events"), "ts", "event_type", "value")


@query("route_latency_minute", """SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS window_start, event_type,
count(*) AS requests, quantile_disc(value, 0.95) AS latency FROM events GROUP BY 1, 2""")
def route_latency_minute(spark, folder):
    """Requests and exact p95 per route and minute."""
    return telemetry.route_latency_exact(table(spark, folder, "events"), "ts", "event_type", "value", "MINUTE")


@query("request_rate", """SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS requests
FROM events GROUP BY 1, 2""")
def request_rate(spark, folder):
    """Requests per minute and route (the sketch percentile next to it is approximate, so not compared)."""
    return telemetry.route_latency(table(spark, folder, "events"), "ts", "event_type", "value").drop("latency")


@query("value_buckets", """WITH v AS (SELECT least(value / 100.0::DOUBLE, 1.0) AS p FROM events),
b AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS le)
SELECT le, (SELECT count(*) FROM v WHERE p <= le) AS observations, (SELECT count(*) FROM v) AS total FROM b""")
def value_buckets(spark, folder):
    """Cumulative histogram over upper bounds 0.1 .. 1.0."""
    return telemetry.cumulative_buckets(table(spark, folder, "events", "value"),
                                        F.least(F.col("value") / 100.0, F.lit(1.0)))


@query("gauge_latest", """SELECT event_type, arg_max(value, (ts, event_id)) AS last_value, max(value) AS max_value,
count(*) AS samples FROM events GROUP BY event_type""")
def gauge_latest(spark, folder):
    return telemetry.gauge(table(spark, folder, "events"), "ts", "value", ["event_type"], "event_id")


@query("counter_increase", """WITH l AS (SELECT DISTINCT event_type FROM events),
d AS (SELECT DISTINCT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start FROM events),
c AS (SELECT d.window_start, l.event_type, count(e.event_id) AS n FROM d CROSS JOIN l
  LEFT JOIN events e ON date_trunc('day', e.ts) = d.window_start AND e.event_type = l.event_type GROUP BY 1, 2)
SELECT *, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY window_start) AS BIGINT) AS total FROM c""")
def counter_increase(spark, folder):
    """Counter per day and label, zero where a label had no events."""
    return telemetry.counter_increase(table(spark, folder, "events"), "ts", "event_type")


# ------------------------------------------------------------------ records


@query("validate_records", """SELECT conv_id, turn,
  array_to_string(list_filter([CASE WHEN NOT (length(text) >= 20) THEN 'text shorter than 20' END,
    CASE WHEN NOT (length(text) <= 1000) THEN 'text longer than 1000' END,
    CASE WHEN NOT (role = 'user') THEN 'from a user' END], lambda x: x IS NOT NULL), ',') AS rejected
FROM conversations""")
def validate_records(spark, folder):
    """Length bounds and role of every message; broken rules are named."""
    messages = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    checks = {**records.text_rules("text", 20, 1000), "from a user": F.col("role") == "user"}
    return records.validate(messages, checks).select(
        "conv_id", "turn", F.array_join("rejected", ",").alias("rejected"))


@query("parse_records", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, FALSE AS malformed FROM events
UNION ALL SELECT -1 - event_id, NULL, TRUE FROM events WHERE event_type = 'error'""")
def parse_records(spark, folder):
    """JSON requests to typed columns; text that is not an object is marked."""
    raw = table(spark, folder, "events", "event_id", "event_type", "props")
    broken = raw.filter("event_type = 'error'").select((-1 - F.col("event_id")).alias("event_id"),
                                                       F.substring("props", 1, 4).alias("props"))
    both = raw.select("event_id", "props").unionByName(broken)
    return records.parse_records(both, "props", "k int").select(
        "event_id", "k", F.col("_malformed").alias("malformed"))


@query("copy_reconcile", "SELECT count(*) AS source_rows, count(*) AS copied_rows, TRUE AS same_content FROM documents")
def copy_reconcile(spark, folder):
    """Copy the complaint table partitioned by product and reconcile counts and contents."""
    return records.copy_table(complaints(spark, folder), scratch_path(spark, "copy"), ["product"])


@query("reconcile_changed_copy", """SELECT count(*) AS source_rows, count(*) AS copied_rows,
count(*) FILTER (WHERE source = 'src1') = 0 AS same_content FROM documents""")
def reconcile_changed_copy(spark, folder):
    """A copy in which one source has another name: as many rows, other contents."""
    cases = complaints(spark, folder)
    changed = cases.withColumn("issue", F.when(F.col("issue") == "src1", "src01").otherwise(F.col("issue")))
    return records.reconcile(cases, changed)


@query("table_refresh", """SELECT lang AS product, count(*) AS cases, FALSE AS empty FROM documents GROUP BY lang""")
def table_refresh(spark, folder):
    """A catalog table refreshed twice, with statistics, checked for emptiness and read back."""
    path = scratch_path(spark, "catalog-table")
    name = "cases_" + path.rsplit("-", 1)[-1]
    cases = complaints(spark, folder).drop("narrative")
    for rows in (cases.limit(0), cases):
        records.refresh_table(rows, name, path=path)
    empty = records.is_empty_index(spark.table(name))
    return spark.table(name).groupBy("product").agg(F.count(F.lit(1)).alias("cases")).withColumn("empty", F.lit(empty))


@query("csv_round_trip", """SELECT doc_id, length(text) AS chars, source FROM documents""")
def csv_round_trip(spark, folder):
    """Write an enriched table as CSV with a header and read it back with its schema."""
    path = scratch_path(spark, "csv")
    records.write_csv(table(spark, folder, "documents", "doc_id", "text", "source"), path)
    back = records.read_csv(spark, path, "doc_id bigint, text string, source string", multi_line=True)
    return back.select("doc_id", F.length("text").alias("chars"), "source")


@query("report_round_trip", """SELECT event_type AS action, count(*) AS n FROM events GROUP BY event_type""")
def report_round_trip(spark, folder):
    path = scratch_path(spark, "report")
    records.write_report(actions.action_counts(_log(spark, folder)), path)
    return records.read_report(spark, path, "action string, n bigint")


@query("reserved_events", f"""SELECT conv_id, turn, substr(sha256('pepper:' || CAST(conv_id AS VARCHAR)), 1, 16) AS visitor,
'pending' AS outcome, 0.05::DOUBLE AS usd, substring(text, 1, 200) AS question FROM conversations WHERE role = 'user'""")
def reserved_events(spark, folder):
    """Incoming questions as freshly reserved audit rows."""
    asked = incoming(spark, folder)
    row = usage.event_row(text.pseudonym("conv_id", "pepper"), F.col("text"), 0.05)
    return asked.select("conv_id", "turn", *row).withColumn("usd", F.col("usd").cast("double"))


@query("paired_labels", """SELECT o_orderkey, o_totalprice, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders""")
def paired_labels(spark, folder):
    """Rows and their separately delivered labels, paired by key with a completeness check."""
    orders = table(spark, folder, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    labels = orders.select("o_orderkey", label_from("o_orderstatus", "F").alias("label"))
    return records.pair_labels(orders.drop("o_orderstatus"), labels, "o_orderkey")
