"""A training corpus from `documents`: five stages, each on all that the one before it kept.

Language identification drops texts in none of the learned languages and sets ``lang``; of near copies (five-word
shingles, similarity 0.8) one stays; documents that hold a benchmark item go; secrets are blanked in the texts;
the rest is cut into pieces.  Every stage's result is written and read again, so a stage starts from a table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, language, near_copies, pieces, secrets
from tidewatch.session import prepare, stage
from tidewatch.sources.tables import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ORACLE_SQL = None           # language models and pieces are beyond SQL; tests/llm/test_pipeline.py has a plain version


def named(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, ``lang`` being the one found."""
    prepare(spark)
    models = language.fit(docs.filter(~F.coalesce(language.held_out(), F.lit(False))))
    found = language.predict(docs, models).filter("NOT rejected")
    return found.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    return near_copies.drop_near_copies(docs, 80)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.decontaminate(docs, table(prepare(spark), sf_dir, "benchmark"))


def blanked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose secrets are replaced, with ``n_chars`` of the new text."""
    prepare(spark)
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every document."""
    prepare(spark)
    coded = pieces.encode_pieces(docs.select("doc_id", "lang", "source", "text"), PIECES, add=("n_tokens", "ids"))
    return coded.drop("text")


STAGES = [("language", named), ("near_copies", single), ("decontamination", unseen), ("secrets", blanked),
          ("pieces", cut)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
