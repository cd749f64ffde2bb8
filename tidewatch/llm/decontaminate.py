"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over word positions; the words under its ones are hashed and those under its zeros may
differ.  The seeds of benchmark items are joined with those at every word of every document.  A hit fixes how an
item would lie on a document, and the alignment is verified there: an item has leaked if some ``WINDOW``
consecutive words of it (all of a shorter one) agree with the document in at least ``PERCENT`` of their places.

The masks below miss no such window: whatever one or two of 8 to 13 words are substituted as far as the
threshold allows, one mask fits between them (``tests/llm/test_decontaminate.py`` tries all cases).  The result
is therefore that of comparing every item with every document at every offset.  Shorter items, which one mask or
two would hold, are found by a hash of all their words and must agree in every place.

Scale: seeds of documents are never shuffled.  Those of the benchmark are broadcast in parts of ``PART`` rows,
so that a large benchmark costs further scans and no memory.  Equal items are looked for once and reported under
each of their ids.  All work on texts is done by Spark's own expressions.

Words are runs of letters and digits, in lower case.  Defined cases: null and empty texts, and texts without a
word, leak nothing; items of fewer than ``LEAST`` words leak if a document holds all of them in a row; rows
that repeat a document or an item are reported once, different items of one id one by one; rows without an id
take part under the null id; equally good offsets are all counted, and the first word reported is the earliest;
empty tables give empty results; further columns are ignored here and kept by ``decontaminate``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import query, table
from tidewatch.session import stage

MASKS = ("111011", "11010011", "11111")
WINDOW, LEAST, PERCENT = 13, 8, 80
PART = 1_000_000            # benchmark seeds broadcast at once, of 24 bytes
BROADCAST_WORDS = 2_000_000     # of the items laid on documents


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def seeds(df: DataFrame, key: str, at: str, masks: dict[int, str]) -> DataFrame:
    """(key, at, seed) of every mask, given by number, at every word of (key, words)."""
    spread = df.select(key, "words", F.size("words").alias("n"), F.posexplode("words").alias(at, "_word"))
    hashed = [F.when(F.col(at) + len(m) <= F.col("n"),
                     F.xxhash64(F.lit(i), *[F.get("words", F.col(at) + k) for k, bit in enumerate(m) if bit == "1"]))
              for i, m in masks.items()]
    return spread.select(key, at, F.explode(F.array(*hashed)).alias("seed")).filter("seed IS NOT NULL")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, n_matched, best_window, first_word, offsets) per document and leaked item: words
    of the item, the most that agree at one offset and in one window, the first agreeing word of the document,
    and the number of offsets."""
    rows = stage(benchmark.select(F.col("item_id").cast("long"), words("text").alias("words"))
                 .filter(F.size("words") > 0).distinct(), "item-rows")
    items = stage(rows.select("words").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    long = dict(enumerate(MASKS))
    sizes = [r[0] for r in items.filter(F.size("words") < LEAST).select(F.size("words")).distinct().collect()]
    whole = {100 + n: "1" * n for n in sorted(sizes)}           # one per length below LEAST
    of_long = seeds(items.filter(F.size("words") >= LEAST), "item", "item_at", long)
    of_short = [seeds(items.filter(F.size("words") == n - 100), "item", "item_at", {n: m}) for n, m in whole.items()]
    wanted = stage(reduce(DataFrame.unionByName, of_short, of_long).distinct(), "seeds")
    parts = -(-wanted.count() // PART) or 1
    texts = docs.select(F.col("doc_id").cast("long"), words("text").alias("words"))
    found = []
    for part in range(parts):
        some = wanted.filter(F.pmod(F.xxhash64("seed"), F.lit(parts)) == part) if parts > 1 else wanted
        found.append(seeds(texts, "doc_id", "doc_at", long | whole).join(F.broadcast(some), "seed").select(
            "doc_id", "item", (F.col("doc_at") - F.col("item_at")).alias("shift")))
    hits = stage(reduce(DataFrame.unionByName, found).distinct(), "hits")

    known = hits.withColumnsRenamed({"doc_id": "_doc", "item": "_item"}).join(
        items.select(F.col("item").alias("_item"), F.col("words").alias("item")), "_item")
    laid_words = known.agg(F.coalesce(F.sum(F.size("item")), F.lit(0))).first()[0]
    known = F.broadcast(known) if laid_words <= BROADCAST_WORDS else known
    laid = texts.join(known, texts["doc_id"].eqNullSafe(known["_doc"]))
    last = F.size("item") - 1
    agree = F.transform(F.sequence(F.lit(0), last), lambda k: F.coalesce(
        F.get("words", F.col("shift") + k) == F.get("item", k), F.lit(False)).cast("int"))
    wide = F.least(F.lit(WINDOW), F.size("item"))
    need = F.when(F.size("item") < LEAST, F.lit(100)).otherwise(F.lit(PERCENT))
    judged = laid.select("doc_id", "_item", "shift", need.alias("need"), wide.alias("wide"), F.size("item").alias("n_words"),
                         agree.alias("agree")).withColumn(
        "best", F.array_max(F.transform(F.sequence(F.lit(0), F.col("n_words") - F.col("wide")), lambda s: F.aggregate(
            F.slice("agree", s + 1, F.col("wide")), F.lit(0), lambda a, x: a + x)))).filter(
        F.col("best") * 100 >= F.col("wide") * F.col("need"))
    per_item = judged.groupBy("doc_id", "_item").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.max(F.aggregate("agree", F.lit(0), lambda a, x: a + x)).cast("long").alias("n_matched"),
        F.max("best").cast("long").alias("best_window"),
        F.min(F.col("shift") + F.array_position("agree", 1) - 1).cast("long").alias("first_word"),
        F.countDistinct("shift").alias("offsets"))
    named = rows.join(items, "words").select(F.col("item").alias("_item"), "item_id")
    return per_item.join(named, "_item").select(
        "doc_id", "item_id", "n_words", "n_matched", "best_window", "first_word", "offsets")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a leaked item."""
    bad = stage(leaks(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct(), "leaked")
    bad = F.broadcast(bad) if bad.count() <= PART else bad
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad"]), "left_anti")


SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'),
        lambda x: x <> '') AS w FROM documents),
b AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, list_filter(regexp_split_to_array(
        lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark)
    WHERE len(w) > 0),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
iw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS pos FROM b),
m AS (SELECT doc_id, item_id, n, dw.pos - iw.pos AS shift, iw.pos AS k, dw.pos AS pos FROM dw JOIN iw USING (word)),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k
    RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS c FROM m),
a AS (SELECT doc_id, item_id, shift, n, count(*) AS matched, max(c) AS best, min(pos) AS first_word FROM c
    GROUP BY ALL HAVING max(c) * 100 >= CASE WHEN n < {LEAST} THEN n * 100 ELSE least(n, {WINDOW}) * {PERCENT} END)
SELECT doc_id, item_id, max(n) AS n_words, max(matched) AS n_matched, max(best) AS best_window,
    min(first_word) AS first_word, count(*) AS offsets FROM a GROUP BY doc_id, item_id
"""


@query("op2_decontaminate", SQL)
def op2_decontaminate(spark, folder):
    """Benchmark items that leaked into whole `documents`."""
    return leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark"))
