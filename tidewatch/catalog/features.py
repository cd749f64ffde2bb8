"""Snapshots, cleaning, sampling, drift and metrics over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.base import query
from tidewatch.catalog.views import (COMPLAINTS, CRM, CRM_CATEGORICAL, CRM_NUMERIC, LANG_ALIASES, SCORED, SNAPSHOTS,
                                     TX, CALENDAR, complaints, crm, customer_snapshots, hash_sql, lookup_case,
                                     scored_crm)
from tidewatch.functions.rules import alias_value
from tidewatch.operators import drift, metrics, sampling
from tidewatch.operators.cleaning import (align_columns, clean, drop_leaky, label_from, prepare_cases,
                                          split_by_type, unparsed)
from tidewatch.operators.snapshots import calendar, churn_rate, matured
from tidewatch.session import stage
from tidewatch.sources.records import key_checks
from tidewatch.sources.tables import table, transactions

# ------------------------------------------------------------------ snapshots


@query("customer_snapshot", f"WITH {SNAPSHOTS} SELECT * FROM snap")
def customer_snapshot(spark, folder):
    """Features and churn label of every customer at every monthly cutoff."""
    return customer_snapshots(spark, folder)


@query("snapshot_churn_rate", f"""WITH {SNAPSHOTS}
SELECT cutoff, count(*) AS customers, avg(churned) AS churn_rate FROM snap GROUP BY cutoff""")
def snapshot_churn_rate(spark, folder):
    return churn_rate(customer_snapshots(spark, folder))


@query("matured_cutoffs", f"""WITH {TX}, {CALENDAR}
SELECT a.cutoff, max(b.cutoff) AS newest_matured, count(b.cutoff) AS matured_cutoffs
FROM cal a LEFT JOIN cal b ON b.cutoff <= a.cutoff - INTERVAL 90 DAY GROUP BY a.cutoff""")
def matured_cutoffs(spark, folder):
    return matured(calendar(transactions(spark, folder).select("ts")))


# ------------------------------------------------------------------ cleaning

_BLANKED = """raw AS (
  SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_orderdate,
         CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE CAST(o_totalprice AS VARCHAR) END AS total_text
  FROM orders)"""


def _blanked(spark, folder):
    """Orders with the total as text, blank while the order is pending (as unbilled customers have it)."""
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus",
                   "o_orderdate", "o_totalprice")
    return orders.withColumn("total_text", F.when(F.col("o_orderstatus") == "P", F.lit(" ")).otherwise(
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"))).drop("o_totalprice")


@query("clean_coerce", f"""WITH {_BLANKED}
SELECT o_orderkey, o_orderpriority, coalesce(TRY_CAST(trim(total_text) AS DOUBLE), 0.0) AS total_text,
       CAST(o_orderstatus = 'F' AS INTEGER) AS label, CAST(o_orderdate AS DATE) AS placed
FROM raw WHERE o_custkey IS NOT NULL AND o_orderdate >= TIMESTAMP '1996-01-01'""")
def clean_coerce(spark, folder):
    """Drop null keys, date predicate, coerce text to number (blank -> 0), derive label and date."""
    rows = _blanked(spark, folder).dropna(subset=["o_custkey"]).filter(
        F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    labelled = rows.withColumn("label", label_from("o_orderstatus", "F")).withColumn(
        "placed", F.col("o_orderdate").cast("date"))
    return clean(labelled, ["o_orderpriority", "total_text"], ["total_text"], keep=["o_orderkey", "label", "placed"])


@query("unparsed_counts", f"""WITH {_BLANKED}
SELECT count(*) FILTER (WHERE TRY_CAST(trim(total_text) AS DOUBLE) IS NULL) AS total_text,
       count(*) FILTER (WHERE TRY_CAST(trim(o_orderpriority) AS DOUBLE) IS NULL) AS o_orderpriority FROM raw""")
def unparsed_counts(spark, folder):
    return unparsed(_blanked(spark, folder), ["total_text", "o_orderpriority"])


@query("alias_values", f"""WITH a AS (SELECT doc_id, {lookup_case("lang", LANG_ALIASES, "lang")} AS product
FROM documents) SELECT product, count(*) AS documents FROM a GROUP BY product""")
def alias_values(spark, folder):
    """Renamed values map to their current name, others stay."""
    docs = table(spark, folder, "documents", "doc_id", "lang")
    return docs.select(alias_value("lang", LANG_ALIASES).alias("product")).groupBy("product").agg(
        F.count(F.lit(1)).alias("documents"))


@query("prepare_cases", f"""SELECT doc_id AS complaint_id, {lookup_case("lang", LANG_ALIASES, "lang")} AS product,
source AS issue, length(text) AS chars FROM documents WHERE text IS NOT NULL AND length(text) >= 100""")
def prepare_cases_query(spark, folder):
    """Documents renamed to complaint columns, one-liners dropped, product names unified."""
    docs = table(spark, folder, "documents", "doc_id", "lang", "source", "text")
    cases = prepare_cases(docs, None, 100, {"doc_id": "complaint_id", "lang": "product", "source": "issue",
                                           "text": "narrative"}, LANG_ALIASES)
    return cases.select("complaint_id", "product", "issue", F.length("narrative").alias("chars"))


@query("leak_free_features", f"""WITH {CRM}
SELECT segment, nation, urgent, balance, orders, spent, 0 AS tickets FROM crm""")
def leak_free_features(spark, folder):
    """Identifier dropped, columns aligned to a model's expected order, absent ones 0."""
    features = drop_leaky(crm(spark, folder), ["customer"])
    text, numeric = split_by_type(features)
    return align_columns(features, [*sorted(text, key=["segment", "nation", "urgent"].index), *numeric, "tickets"])


@query("point_lookup", """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
WHERE c_custkey = (SELECT max(c_custkey) FROM customer)""")
def point_lookup(spark, folder):
    customers = table(spark, folder, "customer")
    newest = customers.agg(F.max("c_custkey")).scalar()
    return customers.filter(F.col("c_custkey") == newest)


@query("key_checks", """WITH per AS (SELECT l_orderkey, l_linenumber, count(*) AS n,
  count(*) FILTER (WHERE l_shipdate IS NULL) + count(*) FILTER (WHERE l_partkey IS NULL) AS nulls
  FROM lineitem GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, CAST(sum(n - 1) AS BIGINT) AS repeated,
       CAST(sum(nulls) AS BIGINT) AS nulls FROM per""")
def key_checks_query(spark, folder):
    """Primary-key and not-null checks of the line items."""
    return key_checks(table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey"),
                      ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"])


# ------------------------------------------------------------------ sampling


@query("exact_sample", f"""SELECT doc_id, source FROM documents
QUALIFY row_number() OVER (ORDER BY {hash_sql("doc_id", 7)}) <= 100""")
def exact_sample(spark, folder):
    """Seeded sample of exactly 100 documents."""
    return sampling.exact_sample(table(spark, folder, "documents", "doc_id", "source"), "doc_id", 100, 7)


@query("hold_out_split", f"""WITH r AS (SELECT complaint_id, product, row_number() OVER (
  ORDER BY {hash_sql("complaint_id")}) AS rn, count(*) OVER () AS n FROM cases)
SELECT complaint_id, product, rn <= least(1000, floor(n * 0.2)) AS held_out FROM r""".replace(
    "WITH r", f"WITH {COMPLAINTS}, r"))
def hold_out_split(spark, folder):
    cases = complaints(spark, folder).select("complaint_id", "product")
    return sampling.hold_out(cases, "complaint_id", 1000, max_fraction=0.2)


@query("stratified_folds", f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (
  PARTITION BY quality ORDER BY {hash_sql("doc_id")}) AS rn FROM labels)
SELECT doc_id, quality, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM r""")
def stratified_folds(spark, folder):
    return sampling.stratified_folds(table(spark, folder, "labels", "doc_id", "quality"), "doc_id", "quality")


@query("stratified_split", f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (
  PARTITION BY quality ORDER BY {hash_sql("doc_id")}) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM r""")
def stratified_split(spark, folder):
    return sampling.stratified_split(table(spark, folder, "labels", "doc_id", "quality"), "doc_id", "quality")


@query("dedup_latest", """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def dedup_latest(spark, folder):
    """One order per customer: the newest."""
    orders = table(spark, folder, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return sampling.dedup(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


# ------------------------------------------------------------------ drift

_SHIFT_SOURCES = ["BUILDING", "MACHINERY"]
_SHIFTED = f"""{CRM},
moved AS (SELECT customer, row_number() OVER (ORDER BY {hash_sql("customer")}) AS rn, count(*) OVER () AS n
          FROM crm WHERE segment IN ('BUILDING', 'MACHINERY')),
cur AS (
  SELECT customer, CASE WHEN rn <= floor(n * 0.7) THEN 'HOUSEHOLD' ELSE segment END AS segment, nation, urgent,
         balance * 1.25 AS balance, orders,
         CASE WHEN orders > 0 THEN balance * 1.25 * orders ELSE 0.0 END AS spent
  FROM crm LEFT JOIN moved USING (customer))"""


def shifted(book):
    """Scenario 'both': +25 % price, 70 % of two segments moved to a third."""
    priced = drift.what_if_price(book, "balance", "spent", "orders")
    return drift.what_if_segment(priced, "customer", "segment", _SHIFT_SOURCES, "HOUSEHOLD")


@query("what_if_price", f"""WITH {CRM} SELECT customer, balance * 1.25 AS balance, orders,
CASE WHEN orders > 0 THEN balance * 1.25 * orders ELSE 0.0 END AS spent FROM crm""")
def what_if_price(spark, folder):
    rows = crm(spark, folder).select("customer", "balance", "orders", "spent")
    return drift.what_if_price(rows, "balance", "spent", "orders")


@query("what_if_segment_shift", f"""WITH {_SHIFTED} SELECT customer, segment FROM cur""")
def what_if_segment_shift(spark, folder):
    rows = crm(spark, folder).select("customer", "segment")
    return drift.what_if_segment(rows, "customer", "segment", _SHIFT_SOURCES, "HOUSEHOLD")


def _unpivot(source: str, columns: list[str], cast: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS {cast}) AS value FROM {source}" for c in columns)


_CAT = f"""cat AS ({_unpivot("crm", CRM_CATEGORICAL, "VARCHAR")}),
pcat AS (SELECT feature, value AS category, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature) AS total
         FROM cat GROUP BY feature, value)"""
_PROBS = "[0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]"
_NUM = f"""num AS ({_unpivot("crm", CRM_NUMERIC, "DOUBLE")}),
edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, {_PROBS}))) AS e FROM num GROUP BY feature),
bins AS (SELECT feature, e, unnest(generate_series(0, len(e) - 2)) AS bin FROM edges),
pbin AS (
  SELECT b.feature, b.bin, count(v.value) AS n, sum(count(v.value)) OVER (PARTITION BY b.feature) AS total
  FROM bins b LEFT JOIN num v ON v.feature = b.feature
    AND (b.bin = 0 OR v.value >= b.e[b.bin + 1]) AND (b.bin = len(b.e) - 2 OR v.value < b.e[b.bin + 2])
  GROUP BY b.feature, b.bin)"""
_CURRENT = f"""ccat AS (
  SELECT feature, value AS category, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature) AS total
  FROM ({_unpivot("cur", CRM_CATEGORICAL, "VARCHAR")}) GROUP BY feature, value),
cbin AS (
  SELECT b.feature, b.bin, count(v.value) AS n, sum(count(v.value)) OVER (PARTITION BY b.feature) AS total
  FROM bins b LEFT JOIN ({_unpivot("cur", CRM_NUMERIC, "DOUBLE")}) v ON v.feature = b.feature
    AND (b.bin = 0 OR v.value >= b.e[b.bin + 1]) AND (b.bin = len(b.e) - 2 OR v.value < b.e[b.bin + 2])
  GROUP BY b.feature, b.bin)"""


def _psi_sql(current: str) -> str:
    fl = "greatest(coalesce({0}.n / {0}.total::DOUBLE, 0.0), 0.0001)"
    r, c = fl.format("r"), fl.format("c")
    return f"""WITH {current}, {_CAT}, {_NUM}, {_CURRENT},
terms AS (
  SELECT coalesce(r.feature, c.feature) AS feature, ({c} - {r}) * ln({c} / {r}) AS t
  FROM pcat r FULL JOIN ccat c ON r.feature = c.feature AND r.category = c.category
  UNION ALL
  SELECT r.feature, ({c} - {r}) * ln({c} / {r}) FROM pbin r JOIN cbin c ON r.feature = c.feature AND r.bin = c.bin),
psi AS (SELECT feature, sum(t) AS psi FROM terms GROUP BY feature)"""


@query("profile_categorical", f"""WITH {CRM}, {_CAT}
SELECT feature, category, n / total::DOUBLE AS freq FROM pcat""")
def profile_categorical(spark, folder):
    return drift.build_profile(crm(spark, folder), CRM_CATEGORICAL, []).select("feature", "category", "freq")


@query("profile_numeric", f"""WITH {CRM}, {_NUM}
SELECT feature, CAST(bin AS INTEGER) AS bin, n / total::DOUBLE AS freq FROM pbin""")
def profile_numeric(spark, folder):
    return drift.build_profile(crm(spark, folder), [], CRM_NUMERIC).select("feature", "bin", "freq")


@query("decile_edges", f"""WITH {CRM}, {_NUM}, p AS (SELECT feature, e, unnest(generate_series(1, len(e))) AS place FROM edges)
SELECT feature, CAST(place AS INTEGER) AS place, round(e[place], 6) AS edge FROM p""")
def decile_edges(spark, folder):
    """Exact, de-duplicated decile edges per numeric column."""
    profile = drift.build_profile(crm(spark, folder), [], CRM_NUMERIC)
    edges = profile.groupBy("feature").agg(F.first("edges").alias("edges"))
    return edges.select("feature", F.posexplode("edges").alias("place", "edge")).select(
        "feature", (F.col("place") + 1).alias("place"), F.round("edge", 6).alias("edge"))


def _psi(spark, folder, change=lambda book: book):
    book = stage(crm(spark, folder), "book")
    profile = drift.build_profile(book, CRM_CATEGORICAL, CRM_NUMERIC)
    return drift.feature_psi(profile, change(book), CRM_CATEGORICAL, CRM_NUMERIC)


@query("feature_psi", f"""{_psi_sql(_SHIFTED)} SELECT feature, round(psi, 6) AS psi FROM psi""")
def feature_psi(spark, folder):
    """PSI per feature under the 'both' scenario."""
    return _psi(spark, folder, shifted).select("feature", F.round("psi", 6).alias("psi"))


@query("feature_psi_unshifted", f"""{_psi_sql(CRM + ", cur AS (SELECT * FROM crm)")}
SELECT feature, round(psi, 6) + 0.0 AS psi FROM psi""")
def feature_psi_unshifted(spark, folder):
    """PSI of the book against itself: zero everywhere."""
    return _psi(spark, folder).select("feature", (F.round("psi", 6) + 0.0).alias("psi"))


_IMPORTANCE = {"segment": 0.52, "nation": 0.08, "urgent": 0.1, "balance": 0.2, "orders": 0.06, "spent": 0.04}


@query("drift_verdict", f"""{_psi_sql(_SHIFTED)},
imp(feature, importance) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _IMPORTANCE.items())})
SELECT string_agg(feature, ',' ORDER BY psi DESC, feature) FILTER (WHERE psi > 0.2) AS drifted_features,
  round(coalesce(sum(importance) FILTER (WHERE psi > 0.2), 0.0), 4) AS drifted_importance_mass,
  coalesce(sum(importance) FILTER (WHERE psi > 0.2), 0.0) > 0.3 AS importance_drift_trigger,
  FALSE AS performance_trigger,
  coalesce(sum(importance) FILTER (WHERE psi > 0.2), 0.0) > 0.3 AS retrain_recommended,
  array_to_string((list(feature ORDER BY round(psi, 4) DESC, feature))[1:5], ',') AS top_features
FROM psi LEFT JOIN imp USING (feature)""")
def drift_verdict(spark, folder):
    """Drifted features, importance mass and the retrain decision under the 'both' scenario, without labels."""
    return _verdict(spark, _psi(spark, folder, shifted))


def _verdict(spark, psi, *aucs):
    importances = spark.createDataFrame(list(_IMPORTANCE.items()), "feature string, importance double")
    verdict = drift.drift_verdict(psi, importances, None, *aucs)
    return verdict.select(F.array_join("drifted_features", ",").alias("drifted_features"),
                          "drifted_importance_mass", "importance_drift_trigger", "performance_trigger",
                          "retrain_recommended",
                          F.array_join(F.slice(F.map_keys("feature_psi"), 1, 5), ",").alias("top_features"))


_AREA = """(SELECT sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) FROM (
  SELECT *, sum(neg) OVER (ORDER BY p) - neg AS below FROM (SELECT churn_probability AS p,
    count(*) FILTER (WHERE {0}) AS pos, count(*) FILTER (WHERE NOT ({0})) AS neg FROM scored GROUP BY 1)))"""


@query("drift_verdict_performance", f"""{_psi_sql(CRM + ", cur AS (SELECT * FROM crm)")},
{SCORED[len(CRM) + 1:].strip()},
area AS (SELECT {_AREA.format("churned = 1")} AS now, {_AREA.format("balance < 3000")} AS before)
SELECT '' AS drifted_features, 0.0::DOUBLE AS drifted_importance_mass, FALSE AS importance_drift_trigger,
  before - now > 0.03 AS performance_trigger, before - now > 0.03 AS retrain_recommended,
  (SELECT array_to_string((list(feature ORDER BY round(psi, 4) DESC, feature))[1:5], ',') FROM psi) AS top_features
FROM area""")
def drift_verdict_performance(spark, folder):
    """The verdict on an unmoved book whose scores no longer fit its labels: the scores order by balance, which the
    reference labels follow and the current ones do not."""
    scored = stage(scored_crm(spark, folder), "scored")
    then = metrics.roc_auc(scored.withColumn("y", (F.col("balance") < 3000).cast("int")), "y", "churn_probability")
    now = metrics.roc_auc(scored, "churned", "churn_probability")
    return _verdict(spark, _psi(spark, folder), now.select("roc_auc").scalar(), then.select("roc_auc").scalar())


_DISTANCE = f"""WITH {_SHIFTED}, {_CAT},
ccat AS (SELECT feature, value AS category, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature) AS total
         FROM ({_unpivot("cur", CRM_CATEGORICAL, "VARCHAR")}) GROUP BY feature, value),
pq AS (SELECT coalesce(r.feature, c.feature) AS feature, coalesce(r.n / r.total::DOUBLE, 0.0) AS p,
              coalesce(c.n / c.total::DOUBLE, 0.0) AS q
       FROM pcat r FULL JOIN ccat c ON r.feature = c.feature AND r.category = c.category),
js AS (SELECT feature, sqrt(greatest((
         sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END)
         + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2, 0.0)) AS distance
       FROM pq GROUP BY feature),
both_ AS (SELECT feature, value, 1 AS r FROM ({_unpivot("crm", CRM_NUMERIC, "DOUBLE")})
          UNION ALL SELECT feature, value, 0 FROM ({_unpivot("cur", CRM_NUMERIC, "DOUBLE")})),
steps AS (SELECT feature, value, sum(r) AS nr, sum(1 - r) AS nc FROM both_ GROUP BY feature, value),
walk AS (SELECT feature, value,
    sum(nr) OVER w / sum(nr) OVER (PARTITION BY feature)::DOUBLE AS fr,
    sum(nc) OVER w / sum(nc) OVER (PARTITION BY feature)::DOUBLE AS fc,
    lead(value) OVER (PARTITION BY feature ORDER BY value) - value AS gap
  FROM steps WINDOW w AS (PARTITION BY feature ORDER BY value)),
dev AS (SELECT feature, stddev_pop(value) AS s FROM both_ WHERE r = 1 GROUP BY feature),
ws AS (SELECT feature, sum(abs(fr - fc) * gap) / greatest(max(s), 0.001) AS distance
       FROM walk JOIN dev USING (feature) GROUP BY feature),
dist AS (SELECT feature, 'categorical' AS kind, distance FROM js
         UNION ALL SELECT feature, 'numeric', distance FROM ws)"""


@query("column_distances", f"{_DISTANCE} SELECT feature, kind, round(distance, 5) AS distance FROM dist")
def column_distances(spark, folder):
    """Jensen-Shannon / normalised Wasserstein distance per column under the 'both' scenario."""
    book = stage(crm(spark, folder), "book")
    return drift.column_distances(book, shifted(book), CRM_CATEGORICAL, CRM_NUMERIC).select("feature", "kind", F.round("distance", 5).alias("distance"))


@query("drift_share_naive", f"""{_DISTANCE} SELECT count(*) FILTER (WHERE distance >= 0.1) AS drifted_columns,
avg(CASE WHEN distance >= 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share,
avg(CASE WHEN distance >= 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.5 AS dataset_drift FROM dist""")
def drift_share_naive(spark, folder):
    book = stage(crm(spark, folder), "book")
    return drift.drift_share(drift.column_distances(book, shifted(book), CRM_CATEGORICAL, CRM_NUMERIC))


# ------------------------------------------------------------------ metrics

_JUDGED = """judged AS (SELECT doc_id, quality AS y, n_chars / (n_chars + 2000.0::DOUBLE) AS p
FROM labels JOIN documents USING (doc_id))"""


def _judged(spark, folder):
    """Labels with a rule score: the longer the text, the better."""
    labels = table(spark, folder, "labels", "doc_id", "quality")
    docs = table(spark, folder, "documents", "doc_id", "n_chars")
    return labels.join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("y"), (F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0))).alias("p"))


@query("auc_exact", f"""WITH {_JUDGED}, s AS (
  SELECT p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM judged GROUP BY p),
r AS (SELECT *, sum(neg) OVER (ORDER BY p) - neg AS below FROM s)
SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
  round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 9) AS roc_auc FROM r""")
def auc_exact(spark, folder):
    return metrics.roc_auc(_judged(spark, folder), "y", "p").withColumn("roc_auc", F.round("roc_auc", 9))


@query("auc_by_segment", f"""WITH {SCORED}, s AS (
  SELECT segment, churn_probability AS p, count(*) FILTER (WHERE churned = 1) AS pos,
         count(*) FILTER (WHERE churned <> 1) AS neg FROM scored GROUP BY 1, 2),
r AS (SELECT *, sum(neg) OVER (PARTITION BY segment ORDER BY p) - neg AS below FROM s)
SELECT segment, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
  round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 9) AS roc_auc
FROM r GROUP BY segment""")
def auc_by_segment(spark, folder):
    return metrics.roc_auc(scored_crm(spark, folder), "churned", "churn_probability", ["segment"]).withColumn(
        "roc_auc", F.round("roc_auc", 9))


@query("brier", f"""WITH {_JUDGED} SELECT round(avg((p - y) * (p - y)), 9) AS brier,
round(avg(p), 9) AS mean_predicted, avg(y) AS observed_rate FROM judged""")
def brier(spark, folder):
    out = metrics.brier(_judged(spark, folder), "y", "p")
    return out.select(F.round("brier", 9).alias("brier"), F.round("mean_predicted", 9).alias("mean_predicted"),
                      "observed_rate")


@query("confusion", f"""WITH {_JUDGED}, c AS (SELECT
  count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y <> 1) AS fp,
  count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y <> 1) AS tn FROM judged)
SELECT tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1 FROM c""")
def confusion(spark, folder):
    return metrics.confusion(_judged(spark, folder), "y", "p")


@query("macro_f1", """WITH d AS (SELECT lang AS t, CASE WHEN n_chars % 3 = 0 THEN 'en' ELSE lang END AS p FROM documents),
c AS (SELECT DISTINCT t AS c FROM d UNION SELECT DISTINCT p FROM d),
m AS (SELECT c, (SELECT count(*) FROM d WHERE t = c AND p = c) AS hit, (SELECT count(*) FROM d WHERE t = c) AS n,
             (SELECT count(*) FROM d WHERE p = c) AS m FROM c),
s AS (SELECT *, CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE hit / m::DOUBLE END AS pr,
  CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE hit / n::DOUBLE END AS re,
  CASE WHEN n + m = 0 THEN 0.0::DOUBLE ELSE 2 * hit / (n + m)::DOUBLE END AS f FROM m)
SELECT count(*) AS classes, sum(hit) / sum(n)::DOUBLE AS accuracy, round(avg(pr), 9) AS precision_macro,
  round(avg(re), 9) AS recall_macro, round(avg(f), 9) AS f1_macro FROM s""")
def macro_f1(spark, folder):
    """Multiclass scores of a rule that calls a third of the texts English."""
    docs = table(spark, folder, "documents", "lang", "n_chars").select(
        "lang", F.when(F.col("n_chars") % 3 == 0, "en").otherwise(F.col("lang")).alias("said"))
    out = metrics.macro_scores(docs, "lang", "said")
    return out.select("classes", "accuracy", *[F.round(c, 9).alias(c) for c in (
        "precision_macro", "recall_macro", "f1_macro")])


@query("top_decile_precision", f"""WITH {_JUDGED}, n AS (
  SELECT greatest(CAST(floor(count(*) * 0.1) AS BIGINT), 1) AS top_n FROM judged),
r AS (SELECT y, row_number() OVER (ORDER BY p DESC, {hash_sql("doc_id")}) AS rn FROM judged)
SELECT max(top_n) AS top_n, avg(y) AS top_precision FROM r, n WHERE rn <= top_n""")
def top_decile_precision(spark, folder):
    return metrics.top_precision(_judged(spark, folder), "y", "p", "doc_id")


@query("class_weights", """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT source, n, sum(n) OVER () / (count(*) OVER () * n)::DOUBLE AS weight FROM c""")
def class_weights(spark, folder):
    return metrics.class_weights(table(spark, folder, "documents", "source"), "source")


@query("fold_summary", f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (
  PARTITION BY quality ORDER BY {hash_sql("doc_id")}) AS rn FROM labels),
f AS (SELECT (rn - 1) % 5 AS fold, avg(quality) AS rate FROM r GROUP BY 1)
SELECT round(avg(rate), 9) AS mean, round(stddev_pop(rate), 9) AS std FROM f""")
def fold_summary(spark, folder):
    """Mean and population deviation over folds."""
    folds = sampling.stratified_folds(table(spark, folder, "labels", "doc_id", "quality"), "doc_id", "quality")
    per = folds.groupBy("fold").agg(F.avg("quality").alias("rate"))
    return metrics.cv_summary(per, "rate").select(F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))
