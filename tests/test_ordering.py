"""Order-dependent operators on skewed keys, against a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import metrics, sampling
from tidewatch.operators.ordering import exact_quantiles, running


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows share one key, and many share one value."""
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}",
             1.0 if rng.random() < 0.3 else float(rng.randrange(50)), rng.randrange(2)) for i in range(1500)]
    return rows, spark.createDataFrame(rows, "id bigint, key string, value double, label int").repartition(6)


@pytest.mark.parametrize("inclusive", [False, True])
def test_running_sums(skewed, inclusive):
    rows, df = skewed
    out = running(df, ["key"], ["value", "id"], {"upto": F.col("label")}, inclusive)
    got = {r["id"]: r["upto"] for r in out.collect()}
    sums = {}
    for id_, key, _, label in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        before = sums.get(key, 0)
        sums[key] = before + label
        assert got[id_] == (sums[key] if inclusive else before)


def test_running_sums_without_keys(skewed):
    rows, df = skewed
    got = {r["id"]: r["n"] for r in running(df, [], ["id"], {"n": F.lit(1)}).collect()}
    assert got == {r[0]: i for i, r in enumerate(sorted(rows))}


def test_exact_quantiles_match_numpy(skewed):
    rows, df = skewed
    probs = [i / 10 for i in range(11)]
    _, edges = exact_quantiles(df.select("key", "value"), "key", "value", probs)
    for r in edges.collect():
        values = [x[2] for x in rows if x[1] == r["key"]]
        assert r["total"] == len(values)
        assert r["quantiles"] == pytest.approx(list(np.quantile(values, probs)))


def test_auc_counts_ties_half(skewed):
    rows, df = skewed
    got = metrics.roc_auc(df, "label", "value").first()["roc_auc"]
    pos, neg = ([r[2] for r in rows if r[3] == x] for x in (1, 0))
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got == pytest.approx(wins / (len(pos) * len(neg)))


def test_auc_needs_both_classes(spark):
    one = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, p double")
    assert metrics.roc_auc(one, "y", "p").first()["roc_auc"] is None


def test_sampling_is_exact_and_repeatable(skewed):
    _, df = skewed
    a, b = (sampling.exact_sample(df, "id", 137, 9).select("id") for _ in range(2))
    assert a.count() == 137 and a.exceptAll(b).isEmpty()
    assert sampling.exact_sample(df, "id", 10_000).count() == 1500


def test_split_and_folds_are_stratified(skewed):
    _, df = skewed
    per = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    split = sampling.stratified_split(df, "id", "label").filter("split = 'train'").groupBy("label").count()
    assert {r["label"]: r["count"] for r in split.collect()} == {k: int(v * 0.8) for k, v in per.items()}
    folds = sampling.stratified_folds(df, "id", "label", 5)
    assert folds.count() == 1500
    for r in folds.groupBy("label", "fold").count().collect():
        assert r["count"] in (per[r["label"]] // 5, per[r["label"]] // 5 + 1)


def test_top_precision_takes_exactly_a_tenth(skewed):
    rows, df = skewed
    got = metrics.top_precision(df, "label", "value", "id").first()
    assert got["top_n"] == 150
    best = sorted(rows, key=lambda r: -r[2])[:150]
    sure = [r for r in best if r[2] > best[-1][2]]
    low = sum(r[3] for r in sure) / 150
    assert low <= got["top_precision"] <= low + (150 - len(sure)) / 150


def test_shuffles_start_with_as_many_partitions_as_the_tables_ask_for(spark, tmp_path, monkeypatch):
    from tidewatch import session

    (tmp_path / "table.parquet").write_bytes(b"x" * 10_000)
    monkeypatch.setattr(session, "INPUT_BYTES", 100)
    try:
        session.prepare(spark, str(tmp_path))
        assert spark.conf.get(session.INITIAL) == "100"
    finally:
        spark.conf.unset(session.INITIAL)
