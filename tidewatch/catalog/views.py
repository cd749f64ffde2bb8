"""The views that give the warehouse tables their role here, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.rules import PRICES, TEAMS
from tidewatch.operators.snapshots import snapshots
from tidewatch.sources.tables import table, transactions

HOME = "NATION_7"

TX = """tx AS (
  SELECT o_custkey AS customer, l_orderkey AS invoice, o_orderdate AS ts, l_partkey AS product,
         CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS value,
         l_returnflag = 'R' AS cancel, n_name AS country
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
  WHERE l_extendedprice > 0)"""

CALENDAR = """edges AS (SELECT min(ts) + INTERVAL 180 DAY AS lo, max(ts) - INTERVAL 90 DAY AS hi FROM tx),
cal AS (
  SELECT unnest(generate_series(
    CASE WHEN date_trunc('month', lo) = lo THEN lo
         ELSE CAST(date_trunc('month', lo) AS TIMESTAMP) + INTERVAL 1 MONTH END,
    hi, INTERVAL 1 MONTH)) AS cutoff FROM edges)"""

SNAPSHOTS = f"""{TX},
{CALENDAR},
past AS (SELECT cutoff, tx.* FROM cal JOIN tx ON ts < cutoff AND ts >= cutoff - INTERVAL 180 DAY),
inv AS (SELECT cutoff, customer, invoice, min(ts) AS date, sum(value) AS value
        FROM past WHERE NOT cancel GROUP BY cutoff, customer, invoice),
f AS (
  SELECT cutoff, customer, max(date) AS last, min(date) AS first, count(*) AS n180,
    count(*) FILTER (WHERE date >= cutoff - INTERVAL 90 DAY) AS n90,
    count(*) FILTER (WHERE date >= cutoff - INTERVAL 180 DAY AND date < cutoff - INTERVAL 90 DAY) AS nprev,
    CAST(sum(value) AS BIGINT) AS s180,
    CAST(coalesce(sum(value) FILTER (WHERE date >= cutoff - INTERVAL 90 DAY), 0) AS BIGINT) AS s90,
    CAST(coalesce(sum(value) FILTER (WHERE date >= cutoff - INTERVAL 180 DAY
                                       AND date < cutoff - INTERVAL 90 DAY), 0) AS BIGINT) AS sprev
  FROM inv GROUP BY cutoff, customer),
prod AS (SELECT cutoff, customer, count(DISTINCT product) AS n FROM past WHERE NOT cancel GROUP BY 1, 2),
canc AS (SELECT cutoff, customer, count(DISTINCT invoice) AS n FROM past WHERE cancel GROUP BY 1, 2),
votes AS (
  SELECT cutoff, customer, country, row_number() OVER (
    PARTITION BY cutoff, customer ORDER BY count(*) DESC, country) AS rn
  FROM past GROUP BY cutoff, customer, country),
fut AS (SELECT DISTINCT cutoff, customer FROM cal JOIN tx
        ON ts >= cutoff AND ts < cutoff + INTERVAL 90 DAY WHERE NOT cancel),
snap AS (
  SELECT f.cutoff, f.customer,
    (epoch_us(f.cutoff) - epoch_us(last)) // 86400000000 AS recency_days,
    (epoch_us(f.cutoff) - epoch_us(first)) // 86400000000 AS tenure_days_capped,
    n180 AS invoices_180d, n90 AS invoices_90d, nprev AS invoices_prev_90d,
    s180 / 10000.0::DOUBLE AS spend_180d, s90 / 10000.0::DOUBLE AS spend_90d,
    sprev / 10000.0::DOUBLE AS spend_prev_90d,
    (s180 / 10000.0::DOUBLE) / n180 AS avg_invoice_value,
    coalesce(prod.n, 0) AS distinct_products_180d,
    CAST(coalesce(canc.n, 0) AS DOUBLE) / (n180 + coalesce(canc.n, 0)) AS return_rate,
    CAST(votes.country = '{HOME}' AS INTEGER) AS is_home,
    CAST(fut.customer IS NULL AS INTEGER) AS churned
  FROM f LEFT JOIN prod USING (cutoff, customer) LEFT JOIN canc USING (cutoff, customer)
    JOIN votes ON votes.cutoff = f.cutoff AND votes.customer = f.customer AND votes.rn = 1
    LEFT JOIN fut ON fut.cutoff = f.cutoff AND fut.customer = f.customer)"""


def customer_snapshots(spark: SparkSession, folder: str, **kwargs) -> DataFrame:
    return snapshots(transactions(spark, folder), home_country=HOME, **kwargs)


# ------------------------------------------------------------------ CRM book

CRM = """ord AS (
  SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent
  FROM orders GROUP BY o_custkey),
crm AS (
  SELECT c_custkey AS customer, c_mktsegment AS segment, n_name AS nation, c_acctbal AS balance,
         coalesce(n, 0) AS orders, coalesce(cents, 0) / 100.0::DOUBLE AS spent,
         CASE WHEN coalesce(urgent, 0) > 0 THEN 'Yes' ELSE 'No' END AS urgent
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN ord ON o_custkey = c_custkey)"""

CRM_CATEGORICAL = ["segment", "nation", "urgent"]
CRM_NUMERIC = ["balance", "orders", "spent"]


def crm(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer: segment, nation, urgent (Yes/No), balance, orders, spent."""
    orders = table(spark, folder, "orders", "o_custkey", "o_totalprice", "o_orderpriority").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.rint(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent_orders"))
    customers = table(spark, folder, "customer", "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    nations = table(spark, folder, "nation", "n_nationkey", "n_name")
    zero = F.lit(0)
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(
        orders, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"), F.col("c_acctbal").alias("balance"),
        F.coalesce("n", zero).alias("orders"), (F.coalesce("cents", zero) / 100.0).alias("spent"),
        F.when(F.coalesce("urgent_orders", zero) > 0, "Yes").otherwise("No").alias("urgent"))


# a transparent score for queries that judge or use scores: the poorer the balance, the riskier; it is between
# 0 and 1 for any balance, a half at 3000
RISK = "round(0.5::DOUBLE - ({0} - 3000.0::DOUBLE) / (2 * (abs({0} - 3000.0::DOUBLE) + 4000)), 4)"


def risk(balance: str) -> Column:
    off = F.col(balance).cast("double") - F.lit(3000.0)
    return F.round(F.lit(0.5) - off / (2 * (F.abs(off) + 4000)), 4)


SCORED = f"""{CRM},
scored AS (
  SELECT *, {RISK.format("balance")} AS churn_probability,
         CAST(orders < 10 AS INTEGER) AS churned
  FROM crm)"""


def scored_crm(spark: SparkSession, folder: str) -> DataFrame:
    return crm(spark, folder).withColumn("churn_probability", risk("balance")).withColumn(
        "churned", (F.col("orders") < 10).cast("int"))


# ------------------------------------------------------------------ usage events

EVENTS = """ev AS (
  SELECT event_id AS id, ts AS "at", user_id AS visitor,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'answered' END AS outcome,
         CAST(CAST(round(value * 100) AS BIGINT) / 10000.0 AS DECIMAL(10, 5)) AS usd,
         event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props
  FROM events)"""


def usage_events(spark: SparkSession, folder: str) -> DataFrame:
    """Agent events: errors are failed questions, a hundredth of the value is the cost."""
    usd = (F.rint(F.col("value") * 100).cast("bigint") / F.lit(10000.0)).cast("decimal(10,5)")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("user_id").alias("visitor"),
        F.when(F.col("event_type") == "error", "failed").otherwise("answered").alias("outcome"),
        usd.alias("usd"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"), "props")


# ------------------------------------------------------------------ complaints

# words of the documents that carry no topic, in all four languages
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "de", "la", "le", "les", "en", "que", "der", "die",
              "und", "des", "el", "los", "un", "est", "du"]
CATEGORIES = sorted(TEAMS)
LANG_ALIASES = {"de": "german", "en": "english", "es": "spanish"}

COMPLAINTS = """cases AS (
  SELECT doc_id AS complaint_id, lang AS product, source AS issue, text AS narrative FROM documents)"""


def complaints(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as complaints: language is the product, source the issue."""
    return table(spark, folder, "documents", "doc_id", "lang", "source", "text").select(
        F.col("doc_id").alias("complaint_id"), F.col("lang").alias("product"),
        F.col("source").alias("issue"), F.col("text").alias("narrative"))


INCOMING = f"""incoming AS (
  SELECT conv_id, turn, text,
    CASE {" ".join(f"WHEN conv_id % 5 = {i} THEN '{c}'" for i, c in enumerate(CATEGORIES))} END AS category,
    round((1 + length(text) % 100) / 100.0::DOUBLE, 2) AS confidence
  FROM conversations WHERE role = 'user')"""


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    return with_rule_category(table(spark, folder, "conversations", "conv_id", "turn", "role", "text").filter(
        F.col("role") == "user").drop("role"))


def with_rule_category(df: DataFrame) -> DataFrame:
    """Category and confidence from a plain rule, where no fitted classifier is wanted."""
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    return df.withColumns({
        "category": F.element_at(names, F.pmod(F.col("conv_id"), F.lit(5)).cast("int") + 1),
        "confidence": F.round((1 + F.length("text") % 100) / F.lit(100.0), 2)})


def sql_list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def price_values() -> str:
    return ", ".join("('{}', {})".format(m, ", ".join(f"{float(x)}::DOUBLE" for x in p)) for m, p in PRICES.items())


def hash_sql(key: str, seed: int | str = 42) -> str:
    return f"md5(CAST({key} AS VARCHAR) || ':{seed}')"


def lookup_case(column: str, table_: dict[str, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in table_.items())
    return f"CASE {whens} ELSE {otherwise} END"


