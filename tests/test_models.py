"""Invariants of the fitted parts: additivity of contributions, calibration, gate, replay rules."""

import datetime as dt
import threading
import time

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewatch.operators import drift
from tidewatch.operators.snapshots import FEATURES
from tidewatch.plans import attribution, backtest, boosting, models, nested, nested_drift, registry, text_classifier
from tidewatch.session import scratch_path, stage

SPEC = models.Spec("id", "y", ["contract"], ["tenure", "charges"], rounds=3)


@pytest.fixture(scope="module")
def book(spark):
    rng = np.random.default_rng(5)
    n = 400
    contract = rng.choice(["month", "year", "two"], n)
    tenure, charges = rng.integers(0, 72, n), rng.uniform(20, 110, n).round(2)
    p = 1 / (1 + np.exp(-(2.0 * (contract == "month") - 0.04 * tenure + 0.01 * charges - 0.5)))
    y = (rng.random(n) < p).astype(int)
    rows = [(i, str(c), int(t), float(x), int(v)) for i, (c, t, x, v) in enumerate(zip(contract, tenure, charges, y))]
    return spark.createDataFrame(rows, "id bigint, contract string, tenure int, charges double, y int").repartition(2).cache()


@pytest.fixture(scope="module")
def bundle(book):
    return models.train(book, SPEC, evaluate=False)


def test_tree_contributions_add_up(spark, book, bundle):
    leaves = attribution.leaves_of(spark, bundle.model.stages[-1])
    base = attribution.expected_log_odds(leaves)
    rows = attribution.with_impacts(models.raw_score(bundle.model, book.limit(60)), bundle.model, SPEC).collect()
    for r in rows:
        assert base + sum(r["impacts"]) == pytest.approx(np.log(r["raw"] / (1 - r["raw"])), abs=1e-6)


def test_closed_form_equals_shapley_by_enumeration():
    from itertools import combinations
    from math import factorial

    leaf = attribution.Leaf(1.7, np.array([0, 1, 2]), np.array([0.0, -np.inf, 1.0]), np.array([2.0, 5.0, np.inf]),
                            np.array([0.3, 0.6, 0.8]))
    x = np.array([[1.0, 9.0, 3.0]])
    passes = np.array([1.0, 0.0, 1.0])
    value = lambda s: 1.7 * np.prod([passes[i] if i in s else leaf.share[i] for i in range(3)])
    expected = [sum(factorial(len(s)) * factorial(2 - len(s)) / 6 * (value({*s, i}) - value(set(s)))
                    for k in range(3) for s in combinations([j for j in range(3) if j != i], k)) for i in range(3)]
    assert attribution.shapley(x, [leaf], np.arange(3), 3)[0] == pytest.approx(expected)


def test_scores(book, bundle):
    out = attribution.score(bundle, book).collect()
    assert len(out) == 400
    for r in out:
        assert 0.0 <= r["churn_probability"] <= 1.0
        impacts = [f["impact"] for f in r["top_risk_factors"]]
        assert len(impacts) <= 3 and impacts == sorted(impacts, reverse=True) and all(i >= 0 for i in impacts)
    rate = book.agg(F.avg("y")).first()[0]
    assert np.mean([r["churn_probability"] for r in out]) == pytest.approx(rate, abs=0.06)
    by_id = {r["id"]: r["churn_probability"] for r in out}
    risky = [r["id"] for r in book.filter("contract = 'month' AND tenure < 12").collect()]
    safe = [r["id"] for r in book.filter("contract = 'two' AND tenure > 48").collect()]
    assert np.mean([by_id[i] for i in risky]) > np.mean([by_id[i] for i in safe])


def test_unseen_category_is_all_zeros(spark, bundle):
    row = spark.createDataFrame([(1, "weekly", 3, 50.0, 0)], "id bigint, contract string, tenure int, charges double, y int")
    x = PipelineModel(bundle.model.stages[:-1]).transform(row).select(vector_to_array("features")).first()[0]
    assert x[:3] == [0.0, 0.0, 0.0] and x[3:] == [3.0, 50.0]


def test_logistic_contributions_add_up(book):
    spec = models.Spec("id", "y", ["contract"], ["tenure", "charges"], learner="logistic")
    model = models.fit(book, spec)
    rows = attribution.with_impacts(models.raw_score(model, book), model, spec, book).collect()
    offsets = {round(float(np.log(r["raw"] / (1 - r["raw"])) - sum(r["impacts"])), 6) for r in rows}
    assert max(offsets) - min(offsets) < 1e-5                # the same base value for every row


def test_boosting_runs_all_rounds_on_all_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(x), int(y)) for i, (x, y) in enumerate(zip(rng.normal(size=300), rng.random(300) < 0.5))]
    noise = spark.createDataFrame(rows, "id bigint, charges double, y int")
    learner = models.fit(noise, models.Spec("id", "y", [], ["charges"], rounds=25)).stages[-1]
    assert learner.getNumTrees == 25
    assert all(t._call_java("rootNode").impurityStats().rawCount() == 300 for t in learner.trees)


def test_boosted_fits_have_a_partition_per_core_until_it_is_large(spark, book, monkeypatch):
    assert [models.partitions(n, 12) for n in (0, 60_000, 3_200_000, 32_000_000)] == [1, 3, 12, 84]
    monkeypatch.setattr(models, "PARTITION_ROWS", 4)
    dealt = []
    monkeypatch.setattr(models, "partitions", lambda n, cores, known=models.partitions: dealt.append(known(n, cores)) or dealt[-1])
    spec = models.Spec("id", "y", ["contract"], ["tenure", "charges"], rounds=3)
    made = models.fit(book, spec)
    assert dealt == [spark.sparkContext.defaultParallelism]        # 400 rows would have been 100 partitions
    one = models.build_pipeline(spec).fit(models.with_positive_weight(book, "y").coalesce(1))
    for model in (made, one):
        assert model.stages[-1].getNumTrees == 3 and len(model.stages) == len(one.stages)
    raw = [{r["id"]: r["raw"] for r in models.raw_score(m, book).collect()} for m in (made, one)]
    assert raw[0] == pytest.approx(raw[1])


def test_models_of_a_table_are_grown_together(spark, book):
    spec = models.Spec("id", "y", ["contract"], ["tenure", "charges"], rounds=6)
    members = {"all": F.lit(True), "some": F.col("id") % 3 != 0, "yearly": F.col("contract") != "month"}
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    made = models.fit_together(book, members, spec)
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - jobs
    assert len(jobs) < 90                   # a job per level of all three models; three separate fits take over 200
    for name, where in members.items():
        rows = book.filter(where)
        one = models.build_pipeline(spec).fit(models.with_positive_weight(rows, "y").coalesce(1))
        got, want = ({r["id"]: r["raw"] for r in models.raw_score(m, book).collect()} for m in (made[name], one))
        assert got == pytest.approx(want)
        assert all(t._call_java("rootNode").impurityStats().rawCount() == rows.count() for t in made[name].stages[-1].trees)
        got, want = ({r["feature"]: r["importance"] for r in models.importances(m, spec, rows).collect()} for m in (made[name], one))
        assert got == pytest.approx(want, abs=0.05)         # a tie of two fields may go either way


def test_boosted_state_is_computed_anew(spark, book, monkeypatch):
    spec = models.Spec("id", "y", ["contract"], ["tenure", "charges"], rounds=7)
    one = models.fit(book, spec)
    monkeypatch.setattr(boosting, "REBASE", 3)
    other = models.fit(book, spec)
    assert one.stages[-1].toDebugString.split("\n")[1:] == other.stages[-1].toDebugString.split("\n")[1:]


def test_thresholds_are_weighted_quantiles():
    assert list(boosting.thresholds(np.array([3.0, 1.0, 3.0, np.nan, 7.0]), np.ones(5), 5)) == [2.0, 5.0]
    x = np.arange(1000.0)
    cut = boosting.thresholds(x, np.where(x < 500, 3.0, 1.0), 1000)
    assert len(cut) == 31 and (cut < 500).sum() == 24      # three quarters of the weight


def test_fits_side_by_side_hold_a_bounded_number_of_rows(spark, book, monkeypatch):
    running, most, lock = [0], [0], threading.Lock()

    def slow(df, spec):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.3)
        with lock:
            running[0] -= 1

    monkeypatch.setattr(models, "fit", slow)
    for rows, at_once in ((12_000_000, 4), (800, 2), (10, 1)):
        monkeypatch.setattr(models, "PARALLEL_ROWS", rows)
        most[0] = 0
        assert list(models.fit_all(dict.fromkeys("abcd", book), None)) == [*"abcd"] and most[0] == at_once


def test_importances_are_shares(bundle):
    got = {r["feature"]: r["importance"] for r in bundle.importances.collect()}
    assert set(got) == {"contract", "tenure", "charges"} and sum(got.values()) == pytest.approx(1, abs=1e-5)


def test_every_row_is_scored_once_out_of_fold(book):
    oof = models.oof_scores(book, models.Spec("id", "y", [], ["tenure"], learner="logistic"))
    assert oof.count() == 400 and oof.select("id").distinct().count() == 400


def test_calibration_is_monotone(spark, book):
    scored = book.select("id", "y", (F.col("charges") / 200).alias("raw"))
    calibrator = models.fit_calibrator(scored, "y")
    probe = spark.range(-20, 121).select((F.col("id") / 100).alias("raw"))
    p = [r["churn_probability"] for r in models.calibrate(calibrator, probe).orderBy("raw").collect()]
    assert p == sorted(p) and 0 <= p[0] and p[-1] <= 1


def test_gate_and_registry(spark, book):
    assert registry.promotion_gate(0.83, 0.84) and not registry.promotion_gate(0.82, 0.84)
    assert not registry.promotion_gate(0.84, 0.84, tolerance=-0.05)
    spec, home = models.Spec("id", "y", [], ["tenure", "charges"], learner="logistic"), scratch_path(spark, "registry-test")
    assert registry.load_model(spark, home, spec) is None
    first = registry.retrain(book, spec, home).first()
    assert first["promoted"] and first["version"] == 1
    recent = book.limit(30).withColumn("id", F.col("id") + 1000)
    second = registry.retrain(book, spec, home, recent, tolerance=-0.5).first()
    assert not second["promoted"] and second["new_labeled_rows"] == 30
    served = registry.load_model(spark, home, spec)
    assert served.report["cv_roc_auc_mean"] == first["candidate_cv_roc_auc"]
    assert attribution.score(served, book, train=book).count() == 400


def test_deployments_only_know_matured_snapshots():
    cutoffs = [dt.datetime(2010, m, 1) for m in range(6, 13)]
    for at in cutoffs[4:]:
        _, newest, previous = backtest.deploy(cutoffs, at)
        assert newest <= at - dt.timedelta(days=90) and previous < newest
    assert backtest.deploy(cutoffs, dt.datetime(2010, 11, 1))[1] == dt.datetime(2010, 8, 1)


def test_replay_rules(spark):
    rng = np.random.default_rng(2)
    rows = []
    for m in range(8):
        at = dt.datetime(2010, 1 + m, 1)
        for c in range(400):
            # behaviour shifts in the seventh month
            x = [float(v) for v in rng.normal(5.0 if m >= 6 else 0.0, 1.0, len(FEATURES))]
            rows.append((at, c, *x, int(rng.random() < (0.8 if x[0] > (5 if m >= 6 else 0) else 0.2))))
    ddl = "cutoff timestamp_ntz, customer bigint, " + ", ".join(f"{f} double" for f in FEATURES) + ", churned int"
    spec = models.Spec("customer", "churned", [], FEATURES, learner="logistic")
    out = backtest.run_backtest(spark.createDataFrame(rows, ddl), dt.datetime(2010, 6, 1), spec)
    got = {(r["month"], r["policy"]): r for r in out.collect()}
    assert len(got) == 9
    assert all(got[m, "static"]["model_trained"] == "2010-06" for m in ("2010-06", "2010-07", "2010-08"))
    assert all(got[m, "monthly"]["model_trained"] == m for m in ("2010-06", "2010-07", "2010-08"))
    assert all(got[m, "monthly"]["matured_auc"] is None for m in ("2010-06", "2010-07", "2010-08"))
    july = got["2010-07", "drift_triggered"]
    # it fired with the old model's drift, and the new model is in service for the same month
    assert july["trigger_fired"] and july["model_trained"] == "2010-07" and july["drift_mass"] > 0.3
    assert got["2010-07", "static"]["trigger_fired"] and not got["2010-06", "static"]["trigger_fired"]
    summary = {r["policy"]: r for r in backtest.summarise(out).collect()}
    assert summary["static"]["retrains"] == 0 and summary["monthly"]["retrain_months"] == ["2010-07", "2010-08"]
    assert backtest.pivot_auc(out).count() == 3


def test_replay_scores_only_what_a_policy_reads(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ddl = "cutoff timestamp_ntz, customer bigint, " + ", ".join(f"{f} double" for f in FEATURES) + ", churned int"
    rows = [(dt.datetime(2010 + m // 12, 1 + m % 12, 1), c, *(float(v) for v in rng.normal(size=len(FEATURES))), c % 2)
            for m in range(16) for c in range(60)]
    asked = []

    def scores(snaps, made, since, key, label, pairs):
        asked.append(pairs)
        return nested.nested_scores(snaps, made, since, key, label, pairs)

    monkeypatch.setattr(backtest, "nested_scores", scores)
    spec = models.Spec("customer", "churned", [], FEATURES, learner="logistic")
    out = backtest.run_backtest(spark.createDataFrame(rows, ddl), None, spec, ["static", "monthly"])
    months = out.select("month").distinct().count()
    # the first model in all months and those it is monitored on, each other model in its own month
    assert out.count() == 2 * months and out.filter("true_roc_auc IS NULL").isEmpty()
    assert len(set().union(*asked)) <= 3 * months


def test_nested_fits_equal_single_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(dt.datetime(2010, 1 + m, 1), i, float(a), float(b * 1000), 7.0, int(rng.random() < 1 / (1 + np.exp(1 - a - b * m))))
            for m in range(5) for i, (a, b) in enumerate(rng.normal(size=(150, 2)))]
    snaps = spark.createDataFrame(rows, "cutoff timestamp_ntz, id bigint, a double, b double, flat double, y int").cache()
    newest = [dt.datetime(2010, m, 1) for m in (2, 3, 5)]
    made = nested.fit_nested(snaps, newest, "y", ["a", "b", "flat"])
    scored = nested.nested_scores(snaps, made, {newest[0]: newest[1]}, "id", "y")
    assert scored.count() == 450
    spec = models.Spec("id", "y", [], ["a", "b", "flat"], learner="logistic")
    for i, at in enumerate(newest):
        train = snaps.filter(F.col("cutoff") <= F.lit(at).cast("timestamp_ntz"))
        pipe = models.build_pipeline(spec)
        pipe.getStages()[-1].setTol(1e-14).setMaxIter(1000)
        one = pipe.fit(models.with_positive_weight(train, "y"))
        assert made.slope[i] == pytest.approx(one.stages[-1].coefficients.toArray(), rel=1e-5, abs=1e-6)
        assert made.intercept[i] == pytest.approx(one.stages[-1].intercept, abs=1e-6)
        weights = {r["feature"]: r["importance"] for r in models.importances(one, spec, train).collect()}
        assert {f: w for a, f, w in made.importances() if a == at} == pytest.approx(weights, abs=2e-6)


def test_newton_sums_of_rows_in_any_order(spark):
    rng = np.random.default_rng(8)
    place, y, x = rng.integers(0, 4, 3000), rng.integers(0, 2, 3000), rng.normal(size=(3000, 2))
    rows = spark.createDataFrame([(float(p), float(v), float(a), float(b)) for p, v, (a, b) in zip(place, y, x)],
                                 "place double, y double, a double, b double").repartition(3)
    weights, since, beta = np.array([2.0, 3.0]), np.array([1.0, 2.0]), rng.normal(size=(2, 3))
    got = nested._sums(rows, weights, since, beta)
    assert got.shape == (2, 1 + 3 + 6)              # loss, gradient, half of the Hessian: one row of sums leaves a task
    for i in range(2):
        of = place <= since[i]
        full, label = np.column_stack([x[of], np.ones(of.sum())]), y[of]
        z, w = full @ beta[i], np.where(label == 1, weights[i], 1.0)
        p = 1 / (1 + np.exp(-z))
        assert got[i, 0] == pytest.approx((w * (np.logaddexp(0, z) - label * z)).sum())
        assert got[i, 1:4] == pytest.approx((w * (p - label)) @ full)
        assert got[i, 4:] == pytest.approx((full.T @ (full * (w * p * (1 - p))[:, None]))[np.triu_indices(3)])


def test_bins_look_a_value_up_once(spark, monkeypatch):
    looked = []
    real = np.unique
    monkeypatch.setattr(nested_drift.np, "unique", lambda x, *a, **k: looked.append(len(x)) or real(x, *a, **k))
    day = [dt.datetime(2010, m, 1) for m in range(1, 6)]
    snaps = spark.createDataFrame([(d, float((7 * i + m) % 40)) for m, d in enumerate(day) for i in range(40)],
                                  "cutoff timestamp_ntz, x double").cache()
    newest = {day[0]: day[2], day[1]: day[3], day[2]: day[4]}
    assert nested_drift.nested_psi(snaps, ["x"], newest).filter("abs(psi) > 1e-9").isEmpty()
    assert 3 * 9 in looked              # the inner edges of all models make one grid


def test_triggered_chain(spark):
    day = [dt.datetime(2010, m, 1) for m in range(1, 13)]
    fires = {(1, 3), (1, 4), (3, 4), (4, 4), (4, 9), (5, 6), (9, 11)}
    rows = [(day[a], day[m], (a, m) in fires) for a in range(12) for m in range(a, 12)]
    read = spark.createDataFrame(rows, "at timestamp_ntz, month timestamp_ntz, trigger_fired boolean")
    chain = backtest.triggered(read, day[1])
    assert sorted(r["at"] for r in chain.collect()) == [day[i] for i in (1, 3, 4, 9, 11)]
    months = spark.createDataFrame([(d,) for d in day[1:]], "month timestamp_ntz")
    got = {r["month"]: (r["monitored"], r["serving"]) for r in backtest.plan("drift_triggered", months, day[1], chain).collect()}
    assert got[day[1]] == (day[1], day[1]) and got[day[3]] == (day[1], day[3]) and got[day[4]] == (day[3], day[4])
    assert got[day[8]] == (day[4], day[4]) and got[day[11]] == (day[9], day[11])


def test_nested_psi_equals_profiles_of_each_model(spark):
    rng = np.random.default_rng(6)
    day = [dt.datetime(2010, m, 1) for m in range(1, 7)]
    rows = [(d, float(rng.integers(0, 9)), float(rng.normal(m, 2)), 3.0, float(rng.random() < 0.02))
            for m, d in enumerate(day) for _ in range(60 + 30 * m)]
    snaps = spark.createDataFrame(rows, "cutoff timestamp_ntz, few double, many double, flat double, rare double").cache()
    names, newest = ["few", "many", "flat", "rare"], {day[1]: day[3], day[2]: day[4], day[4]: day[5]}
    got = {(r["model"], r["cutoff"], r["feature"]): r["psi"] for r in nested_drift.nested_psi(snaps, names, newest).collect()}
    for model, since in newest.items():
        profile = drift.build_profile(snaps.filter(F.col("cutoff") <= F.lit(model).cast("timestamp_ntz")), [], names)
        for at in (d for d in day if d >= since):
            month = snaps.filter(F.col("cutoff") == F.lit(at).cast("timestamp_ntz"))
            for r in drift.feature_psi(profile, month, [], names).collect():
                assert got.pop((model, at, r["feature"]), 0.0) == pytest.approx(r["psi"], abs=1e-12)
    assert not got


def test_classifier_writes_term_counts_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(text_classifier, "stage", lambda df, name: written.append(name) or stage(df, name))
    rows = [(i, "red apple pie" if i % 2 else "blue steel car", "food" if i % 2 else "cars") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, narrative string, product string")
    model = text_classifier.fit_classifier(df, "narrative", "product")
    assert text_classifier.classify(model, df, "narrative").filter("category <> product").isEmpty() and written == ["terms"]
