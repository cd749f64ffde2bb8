"""Connected components of an edge table, by alternating stars.

Each round hangs every node's larger neighbours, then its smaller ones, below its smallest neighbour; rounds
end when nothing changes, after about the logarithm of the longest path.  Smallest neighbours are found by a
grouped minimum (combined before the shuffle) and joined back, so the neighbours of one node, however many,
are never gathered; adaptive execution splits the join of such a node.  Every round is written to the shared
scratch folder: lineage stays short and a lost executor costs one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import stage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node with an edge; the label is the smallest node it can reach."""
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        now = stage(small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                                   F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                    .select("e.*").filter("u <> v").distinct(), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = state
