"""Snapshots, drift, cleaning and rules on small hand-made rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import rules, text
from tidewatch.operators import cleaning, drift, sampling
from tidewatch.operators.snapshots import matured, snapshots
from tidewatch.sources import records

TX = "customer bigint, invoice string, ts timestamp_ntz, product string, value bigint, cancel boolean, country string"


def day(s):
    return dt.datetime.fromisoformat(s)


ROWS = [
    (1, "a", day("2010-01-05T10:00"), "p", 10_000, False, "United Kingdom"),
    (1, "a", day("2010-01-05T10:00"), "q", 20_000, False, "France"),
    (1, "b", day("2010-04-20T23:00"), "p", 50_000, False, "France"),
    (1, "Cb", day("2010-04-21T08:00"), "p", -50_000, True, "United Kingdom"),
    (1, "c", day("2010-06-01T00:00"), "r", 10_000, False, "United Kingdom"),
    (2, "d", day("2010-03-01T00:00"), "p", 40_000, False, "Spain"),
    (3, "Ce", day("2010-05-01T00:00"), "p", -40_000, True, "Spain"),
    # an invoice whose lines straddle a cutoff
    (4, "f", day("2010-05-31T23:59"), "p", 10_000, False, "Spain"),
    (4, "f", day("2010-06-01T00:01"), "q", 30_000, False, "Spain"),
]


@pytest.fixture(scope="module")
def june(spark):
    out = snapshots(spark.createDataFrame(ROWS, TX), "2010-06-01", "2010-07-01")
    return {(r["customer"], r["cutoff"].month): r for r in out.collect()}


def test_snapshot_values(june):
    r = june[1, 6]
    assert (r["recency_days"], r["tenure_days_capped"]) == (41, 146)       # whole elapsed days
    assert (r["invoices_180d"], r["invoices_90d"], r["invoices_prev_90d"]) == (2, 1, 1)
    assert (r["spend_180d"], r["spend_90d"], r["spend_prev_90d"]) == (8.0, 5.0, 3.0)
    assert r["distinct_products_180d"] == 2 and r["return_rate"] == pytest.approx(1 / 3)
    # two lines each way: the alphabetically smaller country wins the tie
    assert r["is_home"] == 0
    assert r["churned"] == 0                                                # buys at the cutoff itself


def test_snapshot_membership(june):
    assert (3, 6) not in june                                               # cancellations only
    assert june[2, 6]["churned"] == 1
    assert june[2, 7]["recency_days"] == 122


def test_straddling_invoice(june):
    assert june[4, 6]["spend_180d"] == 1.0 and june[4, 6]["churned"] == 0
    both = june[4, 7]
    assert (both["invoices_180d"], both["spend_180d"], both["recency_days"]) == (1, 4.0, 30)


def test_future_rows_do_not_change_the_past(spark, june):
    later = [r for r in ROWS if r[2] < day("2010-06-01")] + [
        (1, "z", day("2010-06-15T00:00"), "new", 990_000, False, "Chile"),
        (2, "Cz", day("2010-06-20T00:00"), "new", -10_000, True, "Chile")]
    out = snapshots(spark.createDataFrame(later, TX), "2010-06-01", "2010-06-01").drop("churned")
    got = {r["customer"]: r.asDict() for r in out.collect()}
    for (customer, month), r in june.items():
        if month == 6:
            assert got[customer] == {k: v for k, v in r.asDict().items() if k != "churned"}


def test_maturity_counts_days_not_months(spark):
    months = [day(f"2010-{m:02d}-01") for m in range(6, 12)]
    cal = spark.createDataFrame([(m,) for m in months], "cutoff timestamp_ntz")
    got = {r["cutoff"].month: r["newest_matured"] for r in matured(cal).collect()}
    # 90 days before November 1st is August 3rd
    assert got[11] == day("2010-08-01") and got[8] is None


# ------------------------------------------------------------------ drift


@pytest.fixture(scope="module")
def unit(spark):
    rows = [(a, float(i), 1.0, float(i % 3 == 0)) for i, a in enumerate("xxyz" * 50)]
    return spark.createDataFrame(rows, "a string, n double, constant double, flag double")


def test_psi_of_itself_is_zero(unit):
    profile = drift.build_profile(unit, ["a"], ["n", "constant", "flag"])
    psi = {r["feature"]: r["psi"] for r in drift.feature_psi(profile, unit, ["a"], ["n", "constant", "flag"]).collect()}
    assert set(psi) == {"a", "n", "constant", "flag"} and all(abs(v) < 1e-9 for v in psi.values())


def test_psi_matches_numpy(unit):
    moved = unit.withColumn("n", F.col("n") * 1.3 + 5).withColumn(
        "a", F.when(F.col("a") == "z", "new").otherwise(F.col("a"))).withColumn("flag", F.lit(1.0))
    profile = drift.build_profile(unit, ["a"], ["n", "flag"])
    psi = {r["feature"]: r["psi"] for r in drift.feature_psi(profile, moved, ["a"], ["n", "flag"]).collect()}
    floor = lambda x: np.maximum(np.asarray(x, dtype=float), 1e-4)
    value = lambda r, c: float(np.sum((floor(c) - floor(r)) * np.log(floor(c) / floor(r))))
    assert psi["a"] == pytest.approx(value([.5, .25, .25, 0], [.5, .25, 0, .25]))
    n = np.arange(200.0)
    edges = np.unique(np.quantile(n, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    hist = lambda v: np.histogram(v, bins=edges)[0] / len(v)
    assert psi["n"] == pytest.approx(value(hist(n), hist(n * 1.3 + 5)))
    assert psi["flag"] == 0.0               # a 0/1 column has one open bin and cannot drift


def test_value_on_inner_edge_goes_right(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (-9.0,), (99.0,)], "v double")
    edges = F.array(*[F.lit(x) for x in (1.0, 2.0, 3.0, 4.0)])
    assert [r[0] for r in df.select(drift.bin_of(F.col("v"), edges)).collect()] == [0, 1, 2, 0, 2]


def test_verdict(spark):
    psi = spark.createDataFrame([("a", 0.2), ("b", 0.21), ("c", 0.9)], "feature string, psi double")
    weights = spark.createDataFrame([("b", 0.0), ("c", 0.3)], "feature string, importance double")
    v = drift.drift_verdict(psi, weights, 100, auc=0.80, reference_auc=0.82).first()
    assert v["drifted_features"] == ["c", "b"] and v["drifted_importance_mass"] == 0.3
    assert not v["importance_drift_trigger"] and not v["retrain_recommended"]       # strict comparison
    assert drift.drift_verdict(psi, weights, 100, auc=0.78, reference_auc=0.82).first()["retrain_recommended"]
    with pytest.raises(ValueError, match="at least 100"):
        drift.drift_verdict(psi, weights, 99)


def test_what_if(spark):
    df = spark.createDataFrame([(i, "long" if i < 10 else "short", 10.0, 0 if i == 3 else 2) for i in range(25)],
                               "id bigint, contract string, price double, periods int").withColumn("total", F.lit(0.0))
    moved = drift.what_if_segment(df, "id", "contract", ["long"], "short")
    assert moved.filter("contract = 'long'").count() == 3                   # floor(0.7 x 10) moved
    raised = drift.what_if_price(df, "price", "total", "periods")
    assert raised.filter("price = 12.5 AND total = 25.0").count() == 24
    assert raised.filter("periods = 0 AND total = 0.0").count() == 1


# ------------------------------------------------------------------ cleaning and rules


def one(spark, value, expression, ddl="t string"):
    return spark.createDataFrame([(value,)], ddl).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("value, expected", [
    ("My CARD was charged $35!!  Twice.", "my card was charged twice"), ("", ""), ("\n\t42", "")])
def test_normalize(spark, value, expected):
    assert one(spark, value, text.normalize("t")) == expected


@pytest.mark.parametrize("value, expected", [
    ("I have decided to churn .", "I have decided to."),
    ("Churning , then CHURNED\nbut never unchurned.", ", then but never unchurned."),
    ("no plans", "no plans")])
def test_mask(spark, value, expected):
    assert one(spark, value, text.mask_term("t")) == expected


@pytest.mark.parametrize("value, expected", [
    ("Only one sentence here.", ""), ("Good. Bad!  I will churn. Verdict.", "Good. Bad! I will ."), ("", "")])
def test_drop_last_sentence(spark, value, expected):
    assert one(spark, value, text.drop_last_sentence("t")) == expected


def test_urgency_and_words(spark):
    assert one(spark, "They SUE me", text.is_urgent("t")) and not one(spark, "an issue arose", text.is_urgent("t"))
    assert one(spark, " a  b\nc ", text.word_count("t")) == 3 and one(spark, "", text.word_count("t")) == 1
    assert one(spark, "abcdef", text.truncate("t", 3, "…")) == "abc…" and one(spark, "abc", text.truncate("t", 3, "…")) == "abc"


def test_hash_slot_is_md5_modulo(spark):
    import hashlib

    for word in ("fraud", "card", "x"):
        expected = int(hashlib.md5(word.encode()).hexdigest(), 16)
        for dim in (384, 1000):
            assert one(spark, word, text.hash_slot(F.col("t"), dim)) == expected % dim


def test_tiers_and_offers(spark):
    tiers = [one(spark, p, rules.risk_tier("p"), "p double") for p in (0.6, 0.5999, 0.35, 0.3499)]
    assert tiers == ["high", "medium", "medium", "low"]
    yes, no = F.lit(True), F.lit(False)
    offer = lambda tier, *c: one(spark, tier, rules.retention_offer(F.col("t"), *c))
    assert offer("low", yes, yes, yes) is None
    assert offer("high", yes, yes, yes) == rules.OFFER_CONTRACT
    assert offer("high", no, yes, yes) == rules.OFFER_SUPPORT
    assert offer("medium", no, no, yes) == rules.OFFER_AUTOPAY
    assert offer("medium", no, no, no) == rules.OFFER_DEFAULT


def test_cost(spark):
    price = F.struct(*[F.lit(x).alias(n) for x, n in zip((2.0, 10.0, 0.2, 2.5), ("p_in", "p_out", "p_read", "p_write"))])
    none = F.lit(None).cast("bigint")
    assert one(spark, "", rules.cost_usd(F.lit(1_000_000), F.lit(100_000), none, none, price)) == 3.0


def test_clean(spark):
    df = spark.createDataFrame([("a", " "), ("b", "12.5"), ("c", "x")], "id string, total string")
    got = cleaning.clean(df, ["total"], ["total"], keep=["id"])
    assert [r["total"] for r in got.orderBy("id").collect()] == [0.0, 12.5, 0.0]
    with pytest.raises(ValueError, match="tenure"):
        cleaning.clean(df, ["total", "tenure"])
    with pytest.raises(LookupError):
        cleaning.find(df, "id", "zzz")


def test_prepare_cases(spark):
    df = spark.createDataFrame(
        [("7", "2021-02-01", "Prepaid card", "Yes", "x" * 100), ("8", "2020-12-31", "Mortgage", "No", "x" * 200),
         ("9", "2021-03-01", "Mortgage", None, "x" * 99), ("7", "2021-05-01", "Mortgage", "No", "y" * 150)],
        "`Complaint ID` string, `Date received` string, Product string, timely_response string, narrative string")
    cases = cleaning.prepare_cases(df, "2021-01-01", rename={
        "Complaint ID": "complaint_id", "Date received": "date_received", "Product": "product"})
    rows = sorted((r["complaint_id"], r["product"], r["timely_response"]) for r in cases.collect())
    assert rows == [(7, "Credit card", True), (7, "Mortgage", False)]
    newest = sampling.dedup(cases, ["complaint_id"], [F.col("date_received")])
    assert [r["product"] for r in newest.collect()] == ["Mortgage"]


def test_training_file(spark, tmp_path):
    names = [f.name for f in records.TRAINING_SCHEMA.fields]
    row = {n: "No" for n in names} | {"customerID": "1-A", "SeniorCitizen": "0", "tenure": "0",
                                      "MonthlyCharges": "20.5", "TotalCharges": " ", "Churn": "Yes"}
    (tmp_path / "t.csv").write_text("\n".join([",".join(names + ["Extra"]), ",".join([row[n] for n in names] + ["z"])]))
    got = records.load_training(spark, str(tmp_path / "t.csv")).first()
    assert (got["label"], got["TotalCharges"], got["MonthlyCharges"], got["customerID"]) == (1, 0.0, 20.5, "1-A")


def test_request_validation(spark):
    good = {c: "No" for c in records.CATEGORICAL} | {
        "customerID": "1", "SeniorCitizen": 0, "tenure": 3, "MonthlyCharges": 9.5, "TotalCharges": None}
    rows = records.from_records(spark, [good, {k: v for k, v in good.items() if k != "Contract"}])
    checked = records.validate(rows, records.crm_rules()).collect()
    assert [r["rejected"] for r in checked] == [[], ["Contract required"]]


def test_labels_must_be_complete(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id bigint")
    labels = spark.createDataFrame([(1, True), (2, False)], "id bigint, churned boolean")
    assert records.pair_labels(rows, labels, "id").count() == 2
    with pytest.raises(ValueError, match="one label per row"):
        records.pair_labels(rows, labels.limit(1), "id")


def test_refresh_keeps_begun_readers(spark):
    from tidewatch.session import scratch_path

    path = scratch_path(spark, "refreshed")
    name = "refreshed_" + path.rsplit("-", 1)[-1]
    first = records.refresh_table(spark.range(5), name, path=path)
    begun = spark.table(name)
    assert begun.count() == 5
    second = records.refresh_table(spark.range(10, 13), name, path=path)
    assert first != second
    assert sorted(r.id for r in begun.collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.id for r in spark.table(name).collect()) == [10, 11, 12]
    with pytest.raises(ValueError, match="other columns"):
        records.refresh_table(spark.range(2).withColumn("more", F.lit(1)), name, path=path)
