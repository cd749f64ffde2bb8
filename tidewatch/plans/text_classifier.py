"""Complaint classifier: normalised text, TF-IDF, multinomial logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import normalize
from tidewatch.plans.models import with_balanced_weight
from tidewatch.session import stage


def fit_classifier(df: DataFrame, text: str, label: str, terms: int = 1 << 16, max_iter: int = 20) -> PipelineModel:
    """Labels are indexed alphabetically; classes weigh the same.  Texts are cut into words once, and both fits read the
    written term counts."""
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\s+")
    hashing = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=terms)
    counted = PipelineModel([words, hashing]).transform(df.select(label, normalize(text).alias("_text")))
    rows = with_balanced_weight(stage(counted.select(label, "_tf"), "terms"), label)
    fitted = Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc"),
        IDF(inputCol="_tf", outputCol="features", minDocFreq=2),
        LogisticRegression(labelCol="_label", weightCol="_weight", maxIter=max_iter, regParam=1e-3,
                           family="multinomial"),
    ]).fit(rows)
    return PipelineModel([fitted.stages[0], words, hashing, *fitted.stages[1:]])


def classify(model: PipelineModel, df: DataFrame, text: str) -> DataFrame:
    """``df`` plus category, confidence and the score of every class (4 digits)."""
    names = model.stages[0].labels
    scoring = PipelineModel(model.stages[1:])
    scored = scoring.transform(df.withColumn("_text", normalize(text)))
    p = F.transform(vector_to_array("probability"), lambda x: F.round(x, 4))
    rows = scored.select(*df.columns, p.alias("_p"))
    label = F.array(*[F.lit(n) for n in names])
    best = F.array_max("_p")
    return rows.select(
        *df.columns, F.element_at(label, F.array_position("_p", best).cast("int")).alias("category"),
        best.alias("confidence"), F.map_from_arrays(label, F.col("_p")).alias("scores"))
