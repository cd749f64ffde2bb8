"""Sharding by proportional stratified interleaving.

Within each source, rows are put into a seeded random order; the row of rank r of n stands at (r + 1/2) / n.  All
rows sorted by that number form a sequence in which every source is spread evenly, so any stretch of it has the
mixture of the whole.  The sequence is cut into shards whose counts differ by one at most (the law ``rows``).

Both orders are kept across range partitions with prefix sums, so a source or a whole table of any size is never
in one task; texts take no part in the sorting.

Defined cases: null texts have no bytes (size 8, checksum 0); rows without a source form a source of their own;
equal positions are ordered by source, then by the seeded order; the seeded order is that of an MD5 of seed and
id, then of id, checksum and size, so rows that repeat an id and text may change places, which shows in no
result; rows without an id have one place in the seeded order and are told apart by checksum; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import query, table, utf8
from tidewatch.operators.ordering import running

SEED = "shards"


def interleaved(docs: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) of (doc_id, text, source)."""
    raw = utf8()
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32")).withColumn(
        "place", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    order = ["place", "doc_id", "text_crc32", "size"]
    ranked = running(rows, ["source"], order, {"rank": F.lit(1)}, name="ranked")
    counts = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "_source")
    spread = ranked.join(counts, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "at", (F.col("rank") + 0.5) / F.col("n")).drop("_source", "n", "rank")
    total = rows.count()
    placed = running(spread, [], ["at", "source", *order], {"position": F.lit(1)}, name="interleaved")
    exact = F.expr(f"CAST(position * {shards} DIV {max(total, 1)} AS INT)")
    first = F.expr(f"(CAST(shard AS BIGINT) * {total} + {shards - 1}) DIV {shards}")
    return placed.withColumn("shard", exact).withColumn("slot", F.col("position") - first).select(
        "doc_id", "source", "size", "text_crc32", "shard", "slot")


SQL = f"""
WITH d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size, coalesce(text, '') AS text,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY place, doc_id) - 1 + 0.5::DOUBLE) /
    count(*) OVER (PARTITION BY source) AS frac FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY frac, source, place, doc_id) - 1 AS position, count(*) OVER () AS n FROM r),
c AS (SELECT *, (position * 24) // n AS shard,
    list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t FROM p)
SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'),
        lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
    'rows' AS law, shard, position - (shard * n + 23) // 24 AS slot, NULL AS grown_shard FROM c
"""


@query("op5_sharding", SQL)
def op5_sharding(spark, folder):
    """All `documents` in 24 shards of the same mixture of sources."""
    placed = interleaved(table(spark, folder, "documents", "doc_id", "text", "source"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
