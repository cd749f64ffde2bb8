"""Retention playbook: tiers, offers, actions, digest, at-risk lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.rules import TIERS, driver_text, retention_offer, risk_tier, tier_action
from tidewatch.operators.actions import action_rows

MAX_LIST = 25              # fixed value: longest at-risk list


def apply_playbook(predictions: DataFrame, customers: DataFrame, key: str, month_to_month: Column,
                   wants_support: Column, manual_payment: Column, known_only: bool = False) -> DataFrame:
    """Tier, action and offer per scored customer.

    A prediction without a customer row keeps its tier and gets the default offer, or goes if only known
    customers are wanted.
    """
    joined = predictions.join(customers, key, "inner" if known_only else "left")
    tiered = joined.withColumn("tier", risk_tier("churn_probability"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return tiered.withColumn("action", tier_action("tier")).withColumn("offer", retention_offer(
        "tier", flag(month_to_month), flag(wants_support), flag(manual_payment)))


def playbook_actions(playbook: DataFrame, key: str) -> DataFrame:
    """Log rows for high and medium tiers; low-risk customers are not logged."""
    details = F.struct("churn_probability", "offer", *(["drivers"] if "drivers" in playbook.columns else []))
    return action_rows(playbook, F.col("action"), details, F.col(key))


def digest(playbook: DataFrame, key: str, charges: str, top: int = 5) -> DataFrame:
    """One row: customers per tier, revenue at risk (high and medium), the riskiest high-tier customers with what
    drives their risk (an array ``drivers`` of texts, if there is one) and the offer."""
    tier = F.col("tier")
    at_risk = tier.isin("high", "medium")
    counts = playbook.agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(tier == "high").alias("high"),
        F.count_if(tier == "medium").alias("medium"),
        F.coalesce(F.sum(F.when(at_risk, F.col(charges))), F.lit(0.0)).alias("revenue_at_risk"))
    # a top-k report: k rows at most reach the list
    best = playbook.filter(tier == "high").orderBy(F.col("churn_probability").desc(), F.col(key)).limit(top)
    why = F.array_join("drivers", ", ") if "drivers" in playbook.columns else F.lit(None)
    what = F.concat_ws(" -> ", why, F.col("offer"))
    rank = F.struct((-F.col("churn_probability")).alias("neg"), F.col(key).alias("id"), F.format_string(
        "%s - %.0f%% - %s", F.col(key).cast("string"), F.col("churn_probability") * 100, what).alias("line"))
    lines = best.agg(F.transform(F.array_sort(F.collect_list(rank)), lambda r: r["line"]).alias("l")).scalar()
    return counts.withColumn("top_customers", lines)


def at_risk(scored: DataFrame, key: str, limit: int = 10, min_probability: float = 0.5,
            segment: Column | None = None) -> DataFrame:
    """Riskiest customers first, each with the number of matches; ``limit`` is clamped to 1..25."""
    if segment is not None:
        scored = scored.filter(segment)
    matching = scored.filter(F.col("churn_probability") >= min_probability)
    total = matching.agg(F.count(F.lit(1))).scalar()
    best = matching.orderBy(F.col("churn_probability").desc(), F.col(key)).limit(max(1, min(int(limit), MAX_LIST)))
    out = best.withColumn("risk_tier", risk_tier("churn_probability"))
    if "top_risk_factors" in scored.columns:
        out = out.withColumn("top_risk_drivers", driver_text("top_risk_factors"))
    return out.withColumn("matching", total)


def tier_counts(scored: DataFrame) -> DataFrame:
    """Customers per tier; empty tiers are listed with 0."""
    tier = risk_tier("churn_probability")
    one = scored.agg(*[F.count_if(tier == t).alias(t) for t in TIERS])
    rows = F.array(*[F.struct(F.lit(t).alias("tier"), F.col(t).alias("customers")) for t in TIERS])
    return one.select(F.explode(rows).alias("r")).select("r.*")
