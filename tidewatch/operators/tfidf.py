"""TF-IDF weights: sublinear term frequency, smoothed inverse document frequency, L2 norm.

Texts are brought together by key once; counts, weights and norms of a key are then found where its text is.  They
are counted twice, for the vocabulary and for the weights, as moving texts costs less than moving their words.
"""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import tokens
from tidewatch.operators.ordering import running
from tidewatch.operators.spread import by_key
from tidewatch.session import stage

MIN_DF = 2
BROADCAST_TERMS = 500_000       # of a vocabulary that may be sent to all tasks


def term_counts(df: DataFrame, key: str, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """(key, term, tf) over the whole text, stop words removed."""
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    terms = by_key(df, key, text).select(key, F.explode(tokens(text)).alias("term"))
    counts = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    return counts.filter(~F.col("term").isin(*stop_words)) if stop_words else counts


def vocabulary(counts: DataFrame, documents: int, min_df: int = MIN_DF, max_terms: int | None = None) -> DataFrame:
    """(term, term_id, df, idf) of all terms, or of the most frequent ``max_terms`` (ties: alphabetical)."""
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(
        F.col("df") >= min_df)
    ranked = running(terms.withColumn("_down", -F.col("total")).withColumn("_all", F.lit(0)),
                     ["_all"], ["_down", "term"], {"place": F.lit(1)}, name="vocabulary")
    kept = ranked if max_terms is None else ranked.filter(F.col("place") < max_terms)
    idf = F.ln(F.lit(float(1 + documents)) / (1 + F.col("df"))) + 1
    return kept.select("term", F.col("place").cast("int").alias("term_id"), "df", idf.alias("idf"))


def weights(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, term, term_id, weight), unit length per key.

    A vocabulary that is counted to be small goes to all tasks, and the rows of a key stay where they are; otherwise
    the join is a plain equi join (one row per term on one side, the other open to skew splitting).
    """
    known = vocab.select("term", "term_id", "idf")
    if known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        known = F.broadcast(known)
    raw = counts.join(known, "term").select(
        key, "term", "term_id", ((F.ln(F.col("tf")) + 1) * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "term_id", (F.col("raw") / norm).alias("weight"))


def tfidf(corpus: DataFrame, queries: DataFrame | None, key: str, text: str,
          stop_words: list[str] | None = None, min_df: int = MIN_DF,
          max_terms: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Weights of the corpus, and of the queries under the corpus' vocabulary."""
    documents = corpus.count()
    counts = term_counts(corpus, key, text, stop_words)
    vocab = stage(vocabulary(counts, documents, min_df, max_terms), "vocabulary-idf")
    own = weights(counts, vocab, key)
    if queries is None:
        return own, None
    return own, weights(term_counts(queries, key, text, stop_words), vocab, key)
