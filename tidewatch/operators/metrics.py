"""Model and retrieval metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordering import running
from tidewatch.operators.sampling import shuffle_key


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(df: DataFrame, label: str, score: str, by: list[str] | None = None,
              threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 of ``score >= threshold`` in one aggregate."""
    said, true = F.col(score) >= threshold, F.col(label) == 1
    g = df.groupBy(*(by or [])).agg(
        F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"),
        F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.withColumns({
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn), "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)})


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null when a group lacks one of the classes.

    Scores are first collapsed to one row per distinct value, then ranked without a global sort.
    """
    by = by or []
    per_score = df.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    ranked = running(per_score, by, [score], {"below": F.col("neg")}, name="auc")
    wins = F.col("pos").cast("double") * (F.col("below") + F.col("neg") / 2)
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.groupBy(*by).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.when(pairs > 0, F.sum(wins) / pairs).alias("roc_auc"))


def brier(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    gap = F.col(score) - F.col(label)
    return df.groupBy(*(by or [])).agg(
        F.avg(gap * gap).alias("brier"), F.avg(score).alias("mean_predicted"),
        F.avg(label).alias("observed_rate"))


def macro_scores(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy and unweighted mean precision / recall / F1 over all classes seen on either side."""
    pairs = df.groupBy(F.col(label).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    as_true = pairs.select(F.col("t").alias("c"), "n", F.lit(0).cast("long").alias("m"),
                           F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    as_pred = pairs.select(F.col("p").alias("c"), F.lit(0).cast("long").alias("n"), F.col("n").alias("m"),
                           F.lit(0).cast("long").alias("hit"))
    per = as_true.unionByName(as_pred).groupBy("c").agg(*[F.sum(x).alias(x) for x in ("n", "m", "hit")])
    per = per.withColumns({
        "precision": _ratio(F.col("hit"), F.col("m")), "recall": _ratio(F.col("hit"), F.col("n")),
        "f1": _ratio(2 * F.col("hit"), F.col("n") + F.col("m"))})
    return per.agg(
        F.count(F.lit(1)).alias("classes"), (F.sum("hit") / F.sum("n")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"))


def top_precision(df: DataFrame, label: str, score: str, key: str, fraction: float = 0.10,
                  by: list[str] | None = None, seed: int | str = 42) -> DataFrame:
    """Share of positives among the max(int(fraction x N), 1) highest scores; ties cut in hash order.

    The cut is found on distinct scores; only the rows tied at the cut are ever ranked one by one, and
    those are first counted per hash prefix, so even a huge tie stays distributed.
    """
    by = by or []
    n, pos = F.count(F.lit(1)), F.count_if(F.col(label) == 1)
    per_score = df.groupBy(*by, score).agg(n.alias("n"), pos.alias("pos"))
    per_score = per_score.withColumn("_down", -F.col(score))
    ranked = running(per_score, by, ["_down"], {"above": F.col("n"), "pos_above": F.col("pos")}, name="top")
    sizes = ranked.groupBy(*by).agg(F.greatest(
        F.floor(F.sum("n") * F.lit(fraction)), F.lit(1)).cast("long").alias("top_n"))
    at = ranked.join(F.broadcast(sizes), by) if by else ranked.withColumn("top_n", sizes.scalar())
    border = at.filter((F.col("above") < F.col("top_n")) & (F.col("top_n") <= F.col("above") + F.col("n")))
    border = border.select(*by, F.col(score).alias("_cut"), "top_n", "pos_above",
                           (F.col("top_n") - F.col("above")).alias("_need"))
    # border: one row per group of ``by`` (a model, a month, a segment)
    if by:
        ties = df.join(F.broadcast(border), by).filter(F.col(score) == F.col("_cut"))
    else:
        ties = df.filter(F.col(score) == border.select("_cut").scalar()).withColumn(
            "_need", border.select("_need").scalar())
    ties = ties.select(*by, label, "_need", shuffle_key(key, seed).alias("_hash")).withColumn(
        "_prefix", F.substring("_hash", 1, 4))
    per = ties.groupBy(*by, "_prefix").agg(n.alias("_n"))
    before = Window.partitionBy(*by).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*by, "_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*by, "_prefix").orderBy("_hash"))
    taken = ties.join(per, [*by, "_prefix"]).withColumn("_rank", rank + F.col("_before")).filter(
        F.col("_rank") <= F.col("_need"))
    hits = taken.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("_hits"))
    total = (F.col("pos_above") + F.col("_hits")) / F.col("top_n")
    joined = border.join(hits, by) if by else border.withColumn("_hits", hits.scalar())
    return joined.select(*by, "top_n", total.alias("top_precision"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (K x n_c) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()          # a row per class
    return counts.withColumn("weight", F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n")))


def cv_summary(folds: DataFrame, score: str = "roc_auc") -> DataFrame:
    return folds.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))


def precision_at_k(hits: DataFrame, query: str = "query_id", product: tuple[str, str] = ("q_product", "product"),
                   issue: tuple[str, str] = ("q_issue", "issue")) -> DataFrame:
    """Mean over queries of the share of hits with the same product, and the same product and issue."""
    same = F.coalesce(F.col(product[0]) == F.col(product[1]), F.lit(False))
    both = same & F.coalesce(F.col(issue[0]) == F.col(issue[1]), F.lit(False))
    per_query = hits.groupBy(query).agg(
        F.avg(same.cast("double")).alias("p"), F.avg(both.cast("double")).alias("pi"))
    return per_query.agg(F.count(F.lit(1)).alias("queries"), F.avg("p").alias("same_product"),
                         F.avg("pi").alias("same_product_and_issue"))


def chance_precision(corpus: DataFrame, queries: DataFrame, product: str = "product",
                     issue: str = "issue") -> DataFrame:
    """Expected precision of a random corpus row; unseen or null keys count 0."""
    total = corpus.agg(F.count(F.lit(1)).alias("n")).scalar()
    by_pair = corpus.groupBy(product, issue).agg(F.count(F.lit(1)).alias("n_pair"))
    by_product = by_pair.groupBy(product).agg(F.sum("n_pair").alias("n_product"))
    # queries are counted per (product, issue) first, so the joins see each pair once
    asked = queries.groupBy(product, issue).agg(F.count(F.lit(1)).alias("asked"))
    joined = asked.join(by_product, product, "left").join(by_pair, [product, issue], "left")
    mean = lambda c: F.sum(F.col("asked") * F.coalesce(F.col(c), F.lit(0))) / F.sum("asked") / total
    return joined.agg(F.sum("asked").alias("queries"), mean("n_product").alias("same_product"),
                      mean("n_pair").alias("same_product_and_issue"))
