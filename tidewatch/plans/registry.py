"""Model registry: versioned save and load, promotion gate, run log."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.actions import action_rows
from tidewatch.plans.models import Bundle, Spec, train

FORMAT = 1                       # bundle layout; other layouts are not loaded
TOLERANCE = 0.01                 # fixed value: a candidate may be this much worse
REGISTRY = ("version bigint, format int, spark_version string, trained_at timestamp, cv_roc_auc_mean double, "
            "n_recent_rows bigint, promoted boolean")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/registry"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(REGISTRY).json(path) if exists else spark.createDataFrame([], REGISTRY)


def save_model(bundle: Bundle, folder: str, version: int) -> None:
    """A new version folder first, its registry row last: readers never see half a model."""
    at = f"{folder}/version={version}"
    bundle.model.write().overwrite().save(f"{at}/model")
    bundle.calibrator.write().overwrite().save(f"{at}/calibrator")
    bundle.profile.write.mode("overwrite").parquet(f"{at}/profile")
    bundle.importances.write.mode("overwrite").parquet(f"{at}/importances")
    register(bundle, folder, version, True)


def register(bundle: Bundle, folder: str, version: int, promoted: bool) -> None:
    spark = bundle.importances.sparkSession
    row = (version, FORMAT, spark.version, datetime.now(timezone.utc), bundle.report["cv_roc_auc_mean"],
           bundle.report["n_recent_rows"], promoted)
    spark.createDataFrame([row], REGISTRY).write.mode("append").json(f"{folder}/registry")


def current(spark: SparkSession, folder: str):
    """Registry row of the served model, or None: newest promoted row this code can read."""
    usable = _rows(spark, folder).filter(
        F.col("promoted") & (F.col("format") == FORMAT) & (F.col("spark_version") == spark.version))
    return usable.orderBy(F.col("version").desc()).limit(1).first()


def load_model(spark: SparkSession, folder: str, spec: Spec) -> Bundle | None:
    row = current(spark, folder)
    if row is None:
        return None
    at = f"{folder}/version={row['version']}"
    report = {"cv_roc_auc_mean": row["cv_roc_auc_mean"], "n_recent_rows": row["n_recent_rows"]}
    return Bundle(PipelineModel.load(f"{at}/model"), IsotonicRegressionModel.load(f"{at}/calibrator"),
                  spark.read.parquet(f"{at}/profile"), spark.read.parquet(f"{at}/importances"), report, spec)


def promotion_gate(candidate_auc: float, previous_auc: float | None, tolerance: float = TOLERANCE) -> bool:
    return candidate_auc >= (previous_auc or 0.0) - tolerance


def retrain(base: DataFrame, spec: Spec, folder: str, recent: DataFrame | None = None,
            tolerance: float = TOLERANCE, evaluate: bool = False) -> DataFrame:
    """Train a candidate, promote it when cross-validated AUC holds up, record the decision (eager)."""
    spark = base.sparkSession
    previous = current(spark, folder)
    candidate = train(base, spec, recent, evaluate)
    new, old = candidate.report["cv_roc_auc_mean"], previous["cv_roc_auc_mean"] if previous else 0.0
    version = (_rows(spark, folder).agg(F.max("version")).first()[0] or 0) + 1
    promoted = promotion_gate(new, old, tolerance)
    if promoted:
        save_model(candidate, folder, version)
    else:
        register(candidate, folder, version, False)
    return spark.createDataFrame(
        [(version, promoted, old, new, candidate.report["n_recent_rows"])],
        "version bigint, promoted boolean, previous_cv_roc_auc double, candidate_cv_roc_auc double, "
        "new_labeled_rows bigint")


def retrain_actions(decisions: DataFrame) -> DataFrame:
    """Action rows of retraining decisions, to be appended to the action log."""
    details = F.struct("version", "previous_cv_roc_auc", "candidate_cv_roc_auc", "new_labeled_rows")
    return action_rows(decisions, F.when(F.col("promoted"), "model_promoted").otherwise("model_rejected"), details,
                       F.lit(None).cast("string"))


def log_run(spark: SparkSession, path: str, run: str, values: dict) -> None:
    """Append parameters and metrics of one run as (run, key, value, ts) rows."""
    now = datetime.now(timezone.utc)
    rows = [(run, str(k), None if v is None else str(v), now) for k, v in values.items()]
    spark.createDataFrame(rows, "run string, key string, value string, ts timestamp").write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run string, key string, value string, ts timestamp").json(path)
