"""Feature drift: reference profiles, population stability index, verdict, what-if scenarios.

All columns are unpivoted into (feature, value) and aggregated in one pass; what is joined or broadcast
afterwards has one row per feature, category or bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordering import exact_quantiles, running
from tidewatch.operators.sampling import mark_first
from tidewatch.session import stage

# fixed values: trigger thresholds (all strict), batch minimum, frequency floor
PSI_THRESHOLD = 0.2
MASS_THRESHOLD = 0.3
AUC_DROP_THRESHOLD = 0.03
MIN_BATCH = 100
FLOOR = 1e-4
# fixed values of the unweighted check: distance per column, share of columns
COLUMN_DISTANCE_THRESHOLD = 0.1
COLUMN_SHARE_THRESHOLD = 0.5

DECILES = [min(i * 0.1, 1.0) for i in range(11)]


def _long(df: DataFrame, columns: list[str], as_type: str) -> DataFrame:
    return df.select(*[F.col(c).cast(as_type).alias(c) for c in columns]).unpivot(
        [], columns, "feature", "value")


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    values = _long(df, columns, "string").withColumn("category", F.coalesce("value", F.lit("None")))
    return values.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n"))


def _frequencies(counts: DataFrame, item: str) -> DataFrame:
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "feature").select(
        "feature", item, (F.col("n") / F.greatest(F.col("total"), F.lit(1))).alias("freq"))


def bin_frequencies(bins: DataFrame) -> DataFrame:
    """Shares per feature; a feature has ten bins at most, so a window over them is small."""
    total = F.sum("n").over(Window.partitionBy("feature"))
    return bins.select("feature", "bin", (F.col("n") / F.greatest(total, F.lit(1))).alias("freq"))


def bin_of(value: Column, edges: Column) -> Column:
    """Bin of a value; the outer bins are open and a value on an inner edge belongs to the right bin."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: value >= e))


def bin_counts(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, bin, n) with a row for every bin, empty ones included; a constant has no bins."""
    every = edges.select("feature", F.explode(F.when(
        F.size("edges") > 1, F.sequence(F.lit(0), F.size("edges") - 2))).alias("bin"))
    binned = counts.join(F.broadcast(edges), "feature").filter(F.size("edges") > 1).withColumn(
        "bin", bin_of(F.col("value"), F.col("edges"))).groupBy("feature", "bin").agg(F.sum("n").alias("n"))
    return every.join(binned, ["feature", "bin"], "left").select(
        "feature", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def build_profile(df: DataFrame, categorical: list[str], numeric: list[str],
                  approximate: bool = False) -> DataFrame:
    """Long profile: (feature, kind, category, bin, edges, freq), written out like any model artefact.

    A numeric column without bins (a constant) keeps one row with a null bin so that it stays listed.
    ``approximate`` replaces exact deciles by a mergeable sketch for very wide value ranges.
    """
    parts = []
    if categorical:
        freq = _frequencies(category_counts(df, categorical), "category")
        parts.append(freq.select(
            "feature", F.lit("categorical").alias("kind"), "category", F.lit(None).cast("int").alias("bin"),
            F.lit(None).cast("array<double>").alias("edges"), "freq"))
    if numeric:
        values = _long(df, numeric, "double").filter(F.col("value").isNotNull())
        if approximate:
            counts = values.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
            quantiles = values.groupBy("feature").agg(
                F.percentile_approx("value", DECILES, 10_000).alias("quantiles"))
        else:
            counts, quantiles = exact_quantiles(values, "feature", "value", DECILES)
        edges = quantiles.select("feature", F.array_distinct("quantiles").alias("edges"))
        bins = bin_frequencies(bin_counts(counts, edges))
        parts.append(edges.join(bins, "feature", "left").select(
            "feature", F.lit("numeric").alias("kind"), F.lit(None).cast("string").alias("category"),
            F.col("bin").cast("int").alias("bin"), "edges", "freq"))
    profile = parts[0]
    for more in parts[1:]:
        profile = profile.unionByName(more)
    return stage(profile, "profile")


def psi_term(ref: Column, cur: Column) -> Column:
    r, c = (F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(FLOOR)) for x in (ref, cur))
    return (c - r) * F.ln(c / r)


def paired_frequencies(profile: DataFrame, current: DataFrame, categorical: list[str],
                       numeric: list[str]) -> DataFrame:
    """(feature, kind, ref, cur) for every category or bin of either side."""
    parts = []
    if categorical:
        ref = profile.filter("kind = 'categorical'").select("feature", "category", F.col("freq").alias("ref"))
        cur = _frequencies(category_counts(current, categorical), "category").withColumnRenamed("freq", "cur")
        parts.append(ref.join(cur, ["feature", "category"], "full_outer").select(
            "feature", F.lit("categorical").alias("kind"), "ref", "cur"))
    if numeric:
        ref = profile.filter("kind = 'numeric'")
        edges = ref.groupBy("feature").agg(F.first("edges").alias("edges"))
        # bins first, totals later: the shuffle carries one row per (feature, bin) and map task
        values = _long(current, numeric, "double").filter(F.col("value").isNotNull()).withColumn("n", F.lit(1))
        cur = bin_frequencies(bin_counts(values, edges)).withColumnRenamed("freq", "cur")
        parts.append(ref.select("feature", "bin", F.col("freq").alias("ref")).join(
            cur, ["feature", "bin"], "left").select("feature", F.lit("numeric").alias("kind"), "ref", "cur"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def feature_psi(profile: DataFrame, current: DataFrame, categorical: list[str],
                numeric: list[str]) -> DataFrame:
    pairs = paired_frequencies(profile, current, categorical, numeric)
    # a constant reference column has no bins and a PSI of 0
    term = F.when(F.col("ref").isNull() & F.col("cur").isNull(), F.lit(0.0)).otherwise(
        psi_term(F.col("ref"), F.col("cur")))
    return pairs.groupBy("feature").agg(F.sum(term).alias("psi"))


def drift_verdict(psi: DataFrame, importances: DataFrame, n_rows: int | None = None,
                  auc: float | Column | None = None, reference_auc: float | Column | None = None) -> DataFrame:
    """One row: drifted features and all PSI values (largest first), importance mass on the drifted, both
    triggers, the verdict.

    Needs at least MIN_BATCH rows when ``n_rows`` is given.  ``psi`` has one row per feature.  The areas under
    the curve may be numbers or scalar subqueries.
    """
    if n_rows is not None and n_rows < MIN_BATCH:
        raise ValueError(f"a drift verdict takes at least {MIN_BATCH} rows, not {n_rows}")
    now, then = (x if isinstance(x, Column) else F.lit(x).cast("double") for x in (auc, reference_auc))
    drop = then - now
    performance = F.coalesce(drop > AUC_DROP_THRESHOLD, F.lit(False))
    drifted = F.col("psi") > PSI_THRESHOLD
    scored = psi.join(F.broadcast(importances), "feature", "left")
    ordered = lambda arr: F.transform(F.array_sort(arr), lambda s: s["feature"])
    rank = F.struct((-F.col("psi")).alias("neg"), F.col("feature"))
    shown = F.struct((-F.round("psi", 4)).alias("neg"), F.col("feature"))
    mass = F.coalesce(F.sum(F.when(drifted, F.coalesce("importance", F.lit(0.0)))), F.lit(0.0))
    out = scored.agg(
        ordered(F.collect_list(F.when(drifted, rank))).alias("drifted_features"),
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(shown)), lambda s: F.struct(
            s["feature"], F.abs(s["neg"])))).alias("feature_psi"),
        mass.alias("mass"))
    return out.select(
        "drifted_features", "feature_psi", F.round("mass", 4).alias("drifted_importance_mass"),
        (F.col("mass") > MASS_THRESHOLD).alias("importance_drift_trigger"),
        now.alias("current_roc_auc"), drop.alias("roc_auc_drop"), performance.alias("performance_trigger"),
        ((F.col("mass") > MASS_THRESHOLD) | performance).alias("retrain_recommended"))


def column_distances(reference: DataFrame, current: DataFrame, categorical: list[str],
                     numeric: list[str]) -> DataFrame:
    """(feature, kind, distance): Jensen-Shannon distance or Wasserstein distance in reference deviations."""
    ref = _frequencies(category_counts(reference, categorical), "category").withColumnRenamed("freq", "p")
    cur = _frequencies(category_counts(current, categorical), "category").withColumnRenamed("freq", "q")
    both = ref.join(cur, ["feature", "category"], "full_outer").select(
        "feature", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p", "q")])
    middle = (F.col("p") + F.col("q")) / 2
    half = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / middle)).otherwise(0.0)
    js = both.groupBy("feature").agg(
        F.sqrt(F.greatest((F.sum(half("p")) + F.sum(half("q"))) / 2, F.lit(0.0))).alias("distance"))

    side = lambda df, r: _long(df, numeric, "double").filter(F.col("value").isNotNull()).withColumn("r", F.lit(r))
    counts = side(reference, 1).unionByName(side(current, 0)).groupBy("feature", "value").agg(
        F.sum("r").alias("n_ref"), F.sum(1 - F.col("r")).alias("n_cur"))
    totals = counts.groupBy("feature").agg(
        F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"),
        F.sum(F.col("n_ref") * F.col("value")).alias("s1"))
    walked = running(counts, ["feature"], ["value"], {"b_ref": F.col("n_ref"), "b_cur": F.col("n_cur")},
                     name="distances").join(F.broadcast(totals), "feature")
    gap = lambda a, b: F.abs(a / F.col("t_ref") - b / F.col("t_cur"))
    before = gap(F.col("b_ref"), F.col("b_cur"))
    after = gap(F.col("b_ref") + F.col("n_ref"), F.col("b_cur") + F.col("n_cur"))
    off = F.col("value") - F.col("s1") / F.col("t_ref")
    # area between the two step functions, summed by parts; values are centred on the reference mean
    area = walked.groupBy("feature").agg(
        F.sum(off * (before - after)).alias("area"),
        F.sqrt(F.sum(F.col("n_ref") * off * off) / F.max("t_ref")).alias("deviation"))
    wasserstein = area.select("feature", (F.col("area") / F.greatest(
        F.col("deviation"), F.lit(0.001))).alias("distance"))
    return js.withColumn("kind", F.lit("categorical")).unionByName(
        wasserstein.withColumn("kind", F.lit("numeric")))


def drift_share(distances: DataFrame) -> DataFrame:
    """Unweighted check: how many columns moved, and whether that share calls the dataset drifted."""
    moved = F.col("distance") >= COLUMN_DISTANCE_THRESHOLD
    return distances.agg(
        F.count_if(moved).alias("drifted_columns"), F.avg(moved.cast("double")).alias("share")
    ).withColumn("dataset_drift", F.col("share") >= COLUMN_SHARE_THRESHOLD)


def what_if_price(df: DataFrame, price: str, total: str, periods: str, factor: float = 1.25) -> DataFrame:
    """Raise a price; the total follows as price x periods and is 0 where there were no periods."""
    raised = df.withColumn(price, F.col(price) * factor)
    return raised.withColumn(total, F.when(
        F.col(periods) > 0, F.col(price) * F.col(periods)).otherwise(F.lit(0.0)))


def what_if_segment(df: DataFrame, key: str, segment: str, sources: list[str], target: str,
                    fraction: float = 0.7, seed: int | str = 42) -> DataFrame:
    """Move exactly floor(fraction x n) of the rows in ``sources`` to ``target``."""
    eligible = F.col(segment).isin(sources)
    marked = mark_first(df, key, seed, F.floor(F.col("_total") * F.lit(fraction)), "_moved", where=eligible)
    return marked.withColumn(segment, F.when(F.col("_moved"), F.lit(target)).otherwise(F.col(segment))).select(
        *df.columns)
