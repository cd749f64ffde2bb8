"""Removal of passages that an earlier document holds too, found through anchors at difference-cover positions.

A difference cover modulo ``v`` is a set of residues such that any two positions have a common shift below ``v``
that brings both into the set.  So if two documents share ``window`` words, at whatever positions, they share
the ``window - v + 1`` words at some two cover positions inside.  Only those are hashed:

1. *anchors*: a hash of ``window - v + 1`` words at each cover position (a fifth of all for 50 words), grouped
   to the smallest and largest document; hashes that two documents share are kept;
2. *extension*: each shared anchor reaches over the up to ``v`` windows around it.  Those whole windows are
   compared by the MD5 of their words, and each is removed from all documents but the smallest that has it.

Groups are never gathered: the smallest document of a hash is a minimum that is combined before the shuffle, and
it is joined back as one row per hash, so a passage that a third of all documents hold is split like any skewed
join.  Documents with the same words are judged once: the smallest keeps its part, the others lose all.  Anchors
and windows are written to the shared folder, so that no text is cut twice and a lost executor costs a task.
An anchor's hash has 64 bits, and a false match there only costs work.

Defined cases: null and empty texts have no words; texts of fewer words than a window lose nothing; a passage
that occurs twice in one document, or in rows of one id, does not remove itself; documents without an id lose
nothing and take nothing from others; rows that repeat an id and text get equal results; an empty table gives an
empty result; further columns are kept, and columns that are added replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import query, sha_hex, table, without
from tidewatch.llm.repeats import difference_cover
from tidewatch.session import stage

BLANKS = r"[\x20\x09-\x0D]+"
BROADCAST_ROWS = 1_000_000          # of three numbers each
ADDED = ("n_words", "n_removed", "kept", "kept_sha256")


def word_list(text: str = "text") -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), BLANKS), lambda w: w != "")


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, words): the tag tells apart rows of one id that have different words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_list().alias("words"))
    return rows.withColumn("tag", F.conv(F.substring(F.md5(F.array_join("words", " ")), 1, 15), 16, 10).cast("long"))


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if its number of rows allows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _firsts(rows: DataFrame, key: str) -> DataFrame:
    """(key, first) for the keys that documents of different ids hold."""
    ends = rows.groupBy(key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return ends.filter("first < last").select(key, "first")


def shared_spans(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, tag, spans): the maximal runs [start, end) of words that a document loses."""
    v, cover = difference_cover(window)
    size = window - v + 1
    whole = _named(docs).filter(F.col("doc_id").isNotNull() & (F.size("words") >= window))
    known = stage(whole.select("doc_id", "tag", F.md5(F.array_join("words", " ")).alias("name"),
                               F.size("words").alias("n")), "passage-texts")
    copies = stage(known.join(_firsts(known, "name"), "name").filter("doc_id > first").select(
        "doc_id", "tag", "n").distinct(), "passage-copies")
    single = whole.join(_small(copies.select("doc_id", "tag")), ["doc_id", "tag"], "left_anti")

    hashes = F.transform("words", lambda w: F.xxhash64(w))
    places = F.filter(F.sequence(F.lit(0), F.size("hashes") - size), lambda p: F.array_contains(
        F.array(*[F.lit(int(c)) for c in cover]), (p % v).cast("int")))
    anchors = stage(single.select("doc_id", "tag", hashes.alias("hashes")).select(
        "doc_id", "tag", F.inline(F.transform(places, lambda p: F.struct(
            p.alias("place"), F.xxhash64(F.slice(F.col("hashes"), p + 1, F.lit(size))).alias("anchor"))))), "anchors")
    near = stage(anchors.join(_firsts(anchors, "anchor").select("anchor"), "anchor", "left_semi").groupBy(
        "doc_id", "tag").agg(F.collect_set("place").alias("places")), "anchored")

    last = F.size("words") - window
    starts = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(
        F.greatest(p - (v - 1), F.lit(0)), F.least(p, last)))))
    # an anchor too close to the end for a window at its own place still reaches windows before it
    reach = single.join(_small(near.select("doc_id", "tag")), ["doc_id", "tag"], "left_semi").join(
        near, ["doc_id", "tag"]).withColumn("places", F.filter("places", lambda p: p - (v - 1) <= last))
    windows = stage(reach.filter(F.size("places") > 0).select("doc_id", "tag", "words", F.explode(starts).alias("start"))
                    .select("doc_id", "tag", "start", F.unhex(F.md5(F.array_join(
                        F.slice("words", F.col("start") + 1, F.lit(window)), " "))).alias("window")), "windows")
    lost = windows.join(_firsts(windows, "window"), "window").filter("doc_id > first")
    at = lost.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set("start")).alias("at"))
    final = F.size("at") - 1
    begins = F.filter("at", lambda s, i: (i == 0) | (s - F.get(F.col("at"), i - 1) > window))
    ends = F.filter("at", lambda s, i: (i == final) | (F.get(F.col("at"), i + 1) - s > window))
    spans = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), (b + window).alias("end")))
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end")))
    return stage(at.select("doc_id", "tag", spans.alias("spans")).unionByName(
        copies.select("doc_id", "tag", all_of_it.alias("spans"))), "passage-spans")


def remove_passages(docs: DataFrame, window: int = 50, add: tuple[str, ...] = ADDED) -> DataFrame:
    """``docs`` with the columns named in ``add``: words of the text, how many of them are removed, the words that
    remain joined by blanks, and the SHA-256 of that."""
    kept = without(docs, *add)
    spans = shared_spans(docs, window)
    rows = docs.select(*[docs[c] for c in kept.columns], F.col("doc_id").cast("long").alias("__tw_id"),
                       word_list().alias("__tw_words"))
    rows = rows.withColumn("__tw_tag", F.conv(F.substring(F.md5(F.array_join("__tw_words", " ")), 1, 15), 16, 10)
                           .cast("long"))
    found = _small(spans).select(F.col("doc_id").alias("__tw_id"), F.col("tag").alias("__tw_tag"),
                                 F.col("spans").alias("__tw_spans"))
    joined = rows.join(found, ["__tw_id", "__tw_tag"], "left")
    words, cut = F.col("__tw_words"), F.col("__tw_spans")

    def part(k):
        start = F.coalesce(F.get(cut, k - 1)["end"], F.lit(0))
        return F.slice(words, start + 1, F.coalesce(F.get(cut, k)["start"], F.size(words)) - start)

    parts = F.transform(F.sequence(F.lit(0), F.size(cut)), part)
    left = F.array_join(F.when(cut.isNull(), words).otherwise(F.flatten(parts)), " ")
    gone = F.coalesce(F.aggregate(cut, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]), F.lit(0))
    made = {"n_words": F.size(words).cast("long"), "n_removed": gone.cast("long"), "kept": left,
            "kept_sha256": sha_hex(left)}
    return joined.select(*kept.columns, *[made[c].alias(c) for c in add])


@query("op12_passages", r"""
WITH cut AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
             FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM cut),
windows AS (SELECT doc_id, i, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i
                   ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS hash,
                   count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS n FROM words),
firsts AS (SELECT hash, min(doc_id) AS first FROM windows WHERE n = 50 GROUP BY hash),
lost AS (SELECT DISTINCT doc_id, i + k AS i FROM windows JOIN firsts USING (hash), range(50) t(k)
         WHERE n = 50 AND doc_id > first),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
         FROM words ANTI JOIN lost USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (doc_id)
""")
def op12_passages(spark, folder):
    """What remains of the whole `documents` without the passages of 50 words that a smaller doc_id has too."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    return remove_passages(docs, 50, ("n_words", "n_removed", "kept_sha256")).drop("text")
