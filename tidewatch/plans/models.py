"""Churn model: encoding, boosted trees or logistic regression, out-of-fold scores, calibration, report."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from math import ceil

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import metrics
from tidewatch.operators.drift import build_profile
from tidewatch.operators.sampling import stratified_folds, stratified_split
from tidewatch.plans.boosting import as_model, fit_boosted
from tidewatch.session import stage

# fixed values: hyperparameters of the boosted trees
ROUNDS, DEPTH, RATE, SEED = 200, 4, 0.05, 42
PARALLEL_FITS = 4
PARALLEL_ROWS = 12_000_000      # that the fits running side by side may hold
FOLDS = 5
PARTITION_ROWS = 25_000         # of training rows, as long as there are cores without a partition
LARGE_PARTITION_ROWS = 400_000  # of training rows, when every core has some


@dataclass(frozen=True)
class Spec:
    """What to learn from."""

    key: str
    label: str
    categorical: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    learner: str = "gbt"            # or "logistic"
    rounds: int = ROUNDS

    @property
    def features(self) -> list[str]:
        return [*self.categorical, *self.numeric]


def _encoding(spec: Spec) -> list:
    stages = []
    hot = [f"{c}__hot" for c in spec.categorical]
    if spec.categorical:
        index = [f"{c}__index" for c in spec.categorical]
        stages.append(StringIndexer(inputCols=spec.categorical, outputCols=index, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        # the dropped last slot is the indexer's slot for unseen values
        stages.append(OneHotEncoder(inputCols=index, outputCols=hot))
    return [*stages, VectorAssembler(inputCols=[*hot, *spec.numeric], outputCol="features", handleInvalid="keep")]


def _learner(spec: Spec) -> GBTClassifier | LogisticRegression:
    if spec.learner == "gbt":
        return GBTClassifier(labelCol=spec.label, weightCol="_weight", maxIter=spec.rounds, maxDepth=DEPTH,
                             stepSize=RATE, seed=SEED)
    return LogisticRegression(labelCol=spec.label, weightCol="_weight", maxIter=50, regParam=1e-4)


def build_pipeline(spec: Spec) -> Pipeline:
    """One-hot categories (unseen ones become all zeros), numbers as they are, then the learner."""
    return Pipeline(stages=[*_encoding(spec), _learner(spec)])


def build_baseline(spec: Spec) -> Pipeline:
    """Dummy encoding without the alphabetically first category, standardised, balanced logistic regression."""
    index, dummy = [f"{c}__index" for c in spec.categorical], [f"{c}__dummy" for c in spec.categorical]
    stages = []
    if spec.categorical:
        stages += [StringIndexer(inputCols=spec.categorical, outputCols=index, stringOrderType="alphabetDesc"),
                   OneHotEncoder(inputCols=index, outputCols=dummy, dropLast=True)]
    stages += [VectorAssembler(inputCols=[*dummy, *spec.numeric], outputCol="_assembled"),
               StandardScaler(inputCol="_assembled", outputCol="features", withMean=True, withStd=True),
               LogisticRegression(labelCol=spec.label, weightCol="_weight", maxIter=100)]
    return Pipeline(stages=stages)


def with_positive_weight(df: DataFrame, label: str) -> DataFrame:
    """Positives weigh negatives / positives, negatives 1."""
    ratio = df.agg((F.count_if(F.col(label) == 0) / F.greatest(F.count_if(F.col(label) == 1), F.lit(1)))).scalar()
    return df.withColumn("_weight", F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0)))


def with_balanced_weight(df: DataFrame, label: str) -> DataFrame:
    # one row per class
    weights = metrics.class_weights(df, label).select(label, F.col("weight").alias("_weight"))
    return df.join(F.broadcast(weights), label)


def partitions(rows: int, cores: int) -> int:
    """Every level of a tree is a job, so a partition more is a task more in each of thousands of jobs: at most one per
    core until a partition is large, then as many for each core."""
    return max(1, min(ceil(rows / PARTITION_ROWS), cores * ceil(rows / (cores * LARGE_PARTITION_ROWS))))


def fit(train: DataFrame, spec: Spec) -> PipelineModel:
    """A model of all rows."""
    if spec.learner == "gbt":
        return fit_together(train, {"all": F.lit(True)}, spec)["all"]
    encoder = Pipeline(stages=_encoding(spec)).fit(train)
    weighted = with_positive_weight(train.select(spec.label, *spec.features), spec.label)
    return PipelineModel([*encoder.stages, _learner(spec).fit(encoder.transform(weighted))])


def fit_together(rows: DataFrame, members: dict[str, Column], spec: Spec) -> dict[str, PipelineModel]:
    """Boosted models for sets of the same rows, each level of their trees in one pass (``boosting``)."""
    spark = rows.sparkSession
    grown = fit_boosted(rows, members, spec.label, spec.categorical, spec.numeric, spec.rounds, DEPTH, RATE,
                        lambda n: partitions(n, spark.sparkContext.defaultParallelism))
    return {name: PipelineModel([*_encoded_as(spark, spec, made.labels), as_model(spark, made, _learner(spec))])
            for name, made in grown.items()}


def _encoded_as(spark: SparkSession, spec: Spec, labels: list[list[str]]) -> list:
    """The encoding's fitted stages for known categories."""
    *indexing, assembler = _encoding(spec)
    if not indexing:
        return [assembler]
    # a row per category; the shorter lists start again
    book = [tuple(own[i % len(own)] if own else None for own in labels) for i in range(max(1, *map(len, labels)))]
    named = spark.createDataFrame(book, ", ".join(f"`{c}` string" for c in spec.categorical))
    return [*Pipeline(stages=indexing).fit(named).stages, assembler]


def fit_sets(rows: DataFrame, members: dict[str, Column], spec: Spec) -> dict[str, PipelineModel]:
    """A model for each set of the rows."""
    if spec.learner == "gbt":
        return fit_together(rows, members, spec)
    return fit_all({name: rows.filter(where) for name, where in members.items()}, spec)


def fit_all(frames: dict[str, DataFrame], spec: Spec) -> dict[str, PipelineModel]:
    """A model for each of the frames, some of them fitted at the same time, as far as their rows can be held."""
    rows = max(1, next(iter(frames.values())).count())
    with ThreadPoolExecutor(max(1, min(PARALLEL_FITS, PARALLEL_ROWS // rows))) as pool:
        return dict(zip(frames, pool.map(lambda df: fit(df, spec), frames.values())))


def raw_score(model: PipelineModel, df: DataFrame, name: str = "raw") -> DataFrame:
    """``df`` plus the class-weighted model's probability."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(name))


def folded(df: DataFrame, spec: Spec, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    return stage(stratified_folds(df.select(spec.key, spec.label, *spec.features), spec.key, spec.label, k, seed), "folds")


def fold_members(k: int = FOLDS, name: str = "fold") -> dict[str, Column]:
    """What rows of a folded table each fold's model learns from."""
    return {f"{name}{i}": F.col("fold") != i for i in range(k)}


def fold_scores(fitted: dict[str, PipelineModel], folds: DataFrame, spec: Spec, k: int = FOLDS, name: str = "fold") -> DataFrame:
    """(key, fold, label, raw): every row scored by the model that has not seen it."""
    parts = [raw_score(fitted[f"{name}{i}"], folds.filter(F.col("fold") == i)).select(spec.key, "fold", spec.label, "raw")
             for i in range(k)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return stage(out, "oof")


def oof_scores(df: DataFrame, spec: Spec, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Out-of-fold scores of all rows."""
    folds = folded(df, spec, k, seed)
    return fold_scores(fit_sets(folds, fold_members(k), spec), folds, spec, k)


def fold_aucs(oof: DataFrame, label: str) -> DataFrame:
    return metrics.roc_auc(oof, label, "raw", ["fold"])


def fit_calibrator(scored: DataFrame, label: str, raw: str = "raw") -> IsotonicRegressionModel:
    """Isotonic fit on distinct scores weighted by their counts (the same fit, far fewer points)."""
    points = scored.groupBy(raw).agg(F.avg(F.col(label).cast("double")).alias("rate"),
                                     F.count(F.lit(1)).cast("double").alias("points"))
    return IsotonicRegression(featuresCol=raw, labelCol="rate", weightCol="points", isotonic=True).fit(points)


def calibrate(calibrator: IsotonicRegressionModel, df: DataFrame, raw: str = "raw",
              name: str = "churn_probability") -> DataFrame:
    """Clipped outside the fitted range, interpolated inside."""
    p = F.greatest(F.least(F.col("prediction"), F.lit(1.0)), F.lit(0.0))
    return calibrator.setFeaturesCol(raw).transform(df).select(*df.columns, p.alias(name))


def slots(model: PipelineModel, spec: Spec) -> list[str]:
    """The raw field behind every position of the feature vector."""
    out = []
    if spec.categorical:
        for name, values in zip(spec.categorical, model.stages[0].labelsArray):
            out += [name] * len(values)
    return out + list(spec.numeric)


def importances(model: PipelineModel, spec: Spec, train: DataFrame | None = None) -> DataFrame:
    """(feature, importance): slot importances summed back to raw fields, normalised, 6 digits.

    Logistic models use |coefficient| x the slot's deviation over ``train``.
    """
    learner = model.stages[-1]
    if spec.learner == "gbt":
        values = learner.featureImportances.toArray()
    else:
        features = PipelineModel(model.stages[:-1]).transform(train)
        spread = features.select(Summarizer.std(F.col("features"))).first()[0]
        values = abs(learner.coefficients.toArray()) * spread.toArray()
    total: dict[str, float] = {f: 0.0 for f in spec.features}
    for name, value in zip(slots(model, spec), values):
        total[name] += float(value)
    norm = sum(total.values()) or 1.0
    rows = [(name, round(value / norm, 6)) for name, value in total.items()]      # a row per column
    spark = train.sparkSession if train is not None else SparkSession.builder.getOrCreate()
    return spark.createDataFrame(rows, "feature string, importance double")


@dataclass
class Bundle:
    """Everything that is served, monitored and compared."""

    model: PipelineModel
    calibrator: IsotonicRegressionModel
    profile: DataFrame
    importances: DataFrame
    report: dict
    spec: Spec


def holdout_report(model: PipelineModel, oof: DataFrame, test: DataFrame, spec: Spec) -> dict:
    """Metrics on unseen rows, decisions at the raw model's 0.5, and what calibration on ``oof`` changes."""
    calibrator = fit_calibrator(oof, spec.label)
    scored = stage(calibrate(calibrator, raw_score(model, test), name="calibrated").select(
        spec.label, "raw", "calibrated"), "holdout")
    said = metrics.confusion(scored, spec.label, "raw").first()
    raw, cal = (metrics.brier(scored, spec.label, c).first() for c in ("raw", "calibrated"))
    return {
        **{m: said[m] for m in ("accuracy", "precision", "recall", "f1")},
        "roc_auc": metrics.roc_auc(scored, spec.label, "raw").first()["roc_auc"],
        "brier_raw": raw["brier"], "brier_calibrated": cal["brier"],
        "mean_predicted_raw": raw["mean_predicted"], "mean_predicted_calibrated": cal["mean_predicted"],
        "observed_churn_rate": raw["observed_rate"],
    }


def train(base: DataFrame, spec: Spec, recent: DataFrame | None = None, evaluate: bool = True) -> Bundle:
    """Hold-out evaluation, cross-validation, and a model of all rows for serving.

    ``recent`` are newly labelled rows appended to the base data.
    """
    columns = [spec.key, spec.label, *spec.features]
    rows, n_recent = base.select(*columns), 0
    if recent is not None:
        added = recent.select(*columns)
        n_recent = added.count()
        rows = rows.unionByName(added)
    rows = stage(rows, "training")
    folds = folded(rows, spec)
    # rows without a key or a label are in no fold
    loose = rows.filter(F.col(spec.key).isNull() | F.col(spec.label).isNull()).withColumn("fold", F.lit(None).cast("int"))
    fitted = fit_sets(folds.unionByName(loose), {"serving": F.lit(True), **fold_members()}, spec)
    if evaluate:
        split = stage(stratified_split(rows, spec.key, spec.label), "split")
        seen, unseen = (split.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
        inner = folded(seen, spec)
        fitted |= fit_sets(inner, {"holdout": F.lit(True), **fold_members(name="inner")}, spec)
    report: dict = {"n_recent_rows": n_recent}
    if evaluate:
        report |= holdout_report(fitted["holdout"], fold_scores(fitted, inner, spec, name="inner"), unseen, spec)
    oof = fold_scores(fitted, folds, spec)
    cv = metrics.cv_summary(fold_aucs(oof, spec.label)).first()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(spec.label).alias("rate")).first()
    weights = importances(fitted["serving"], spec, rows)
    report |= {"n_rows": size["n"], "churn_rate": size["rate"], "cv_roc_auc_mean": cv["mean"],
               "cv_roc_auc_std": cv["std"]}
    return Bundle(fitted["serving"], fit_calibrator(oof, spec.label), build_profile(rows, spec.categorical, spec.numeric),
                  weights, report, spec)


def report_frame(bundle: Bundle) -> DataFrame:
    """The report as one row, with the five most important fields."""
    spark = bundle.importances.sparkSession
    numbers = {k: float(v) for k, v in bundle.report.items() if v is not None}
    top = [r["feature"] for r in bundle.importances.orderBy(F.col("importance").desc(), "feature").limit(5).collect()]
    shape = ", ".join(f"{k} double" for k in numbers) + ", top_features array<string>"
    return spark.createDataFrame([(*numbers.values(), top)], shape)


def impact_structs(features: list[str], impacts: Column) -> Column:
    """Array of (feature, value, impact) from an impact array aligned with ``features``."""
    return F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value"),
                              impacts[i].alias("impact")) for i, f in enumerate(features)])
