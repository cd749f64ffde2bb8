"""Exact top-k search by histogram selection.

Vectors are turned into whole numbers and packed into blocks; every block of queries meets every block of
candidates of its dimension in one matrix product.  What leaves a product is, per query, the histogram bins of
its k largest scores there (no lower one can hold the k-th score of all), so a round of counting costs at most k
rows per query and block.  Rounds narrow each query's interval to the bin that holds its k-th score, ``BINS``
times finer each, until the score itself is known.  Last, scores above it and, of those equal to it, the
smallest ids are taken: ties need no more than k ids per block either, whatever their number.

Blocks of candidates are dealt into groups; a group meets all blocks of queries, so queries are copied once per
group and candidates never.  No side is broadcast.  Products are exact: they are done in floating point while all
sums stay below 2**53, else in 64-bit integers.

Defined cases: vectors that are null or empty or hold a null, NaN or infinite component, and rows without an id,
take no part; a query is compared with vectors of its own length, and not with rows of its own id; a query that
finds fewer than k gets all; rows that repeat a query's id are separate queries of that id; equal scores rank by
candidate id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.base import query, table
from tidewatch.session import stage

SCALE = 256
BINS = 4096
QUERIES, CANDIDATES = 256, 2048         # vectors in a block
GROUP_BYTES = 128 << 20                 # of candidates that share one copy of the queries
PACKED = "block long, dim int, n int, norm double, ids binary, vectors binary"


def packed(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of (vec_id, embedding): components times ``SCALE``, rounded down."""
    def run(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}
        number = TaskContext.get().partitionId() << 32

        def flush(dim):
            nonlocal number
            parts = held.pop(dim)
            ids, rows = np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts])
            for at in range(0, len(ids), size):
                part = rows[at:at + size]
                norm = math.sqrt(float((part.astype(np.float64) ** 2).sum(1).max()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(part)], pa.int32()),
                     pa.array([norm], pa.float64()), pa.array([ids[at:at + size].tobytes()], pa.binary()),
                     pa.array([part.tobytes()], pa.binary())], names=[c.split()[0] for c in PACKED.split(", ")])
                number += 1

        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ids, starts = batch.column(0).to_numpy(), np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                rows = values[starts[at][:, None] + np.arange(dim)]
                scaled = np.floor(rows * SCALE)
                if np.abs(scaled).max(initial=0.0) >= LARGEST:
                    raise OverflowError("a component times 256 does not fit 64 bits")
                held.setdefault(dim, []).append((ids[at], scaled.astype(np.int64)))
                count[dim] = count.get(dim, 0) + len(at)
                if count[dim] >= size:
                    yield from flush(dim)
                    count[dim] = 0
        for dim in list(held):
            yield from flush(dim)

    value = F.col("embedding").cast("array<double>")
    whole = value.isNotNull() & F.col("vec_id").isNotNull() & (F.size(value) > 0) & ~F.exists(
        value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(whole).select(F.col("vec_id").cast("long"), value.alias("embedding")).mapInArrow(run, PACKED)


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores, whether each may be taken) of a pair of blocks."""
    q = np.frombuffer(row["q_vectors"], np.int64).reshape(-1, row["dim"])
    c = np.frombuffer(row["vectors"], np.int64).reshape(-1, row["dim"])
    q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    if row["q_norm"] * row["norm"] < 2.0**52:
        scores = (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        if row["q_norm"] * row["norm"] >= LARGEST:
            raise OverflowError("scores do not fit 64 bits")
        scores = q @ c.T
    return q_ids, ids, scores, q_ids[:, None] != ids[None, :]


_LOWEST = np.iinfo(np.int64).min
LARGEST = 2.0**62


def _top_bins(k: int):
    """Counts (q_block, place, bin, n) of the bins of each query's k largest scores in a pair of blocks."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, _, scores, free = _scores(row)
                low, width = (np.frombuffer(row[x], np.int64)[:, None] for x in ("low", "width"))
                scores = np.where(free, scores, _LOWEST)
                if scores.shape[1] > k:
                    scores = -np.partition(-scores - 1, k - 1, axis=1)[:, :k] - 1     # -x - 1 cannot overflow
                place = np.broadcast_to(np.arange(len(scores))[:, None], scores.shape)
                use = (scores >= low) & (scores > _LOWEST)
                bins = ((scores - np.minimum(low, scores)) // width)[use]
                pair, n = np.unique(np.stack([place[use], bins]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), row["q_block"]), pa.int64()), pa.array(pair[0], pa.int64()),
                     pa.array(pair[1], pa.int64()), pa.array(n, pa.int64())], names=["q_block", "place", "bin", "n"])
    return run


def _take(k: int):
    """Scores above the k-th of a query, and the smallest ids of those equal to it."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, ids, scores, free = _scores(row)
                least = np.frombuffer(row["low"], np.int64)[:, None]
                place, at = np.nonzero((scores > least) & free)
                tied, where = np.nonzero((scores == least) & free)
                order = np.lexsort((ids[where], tied))
                tied, where = tied[order], where[order]
                first = np.searchsorted(tied, np.arange(len(q_ids)))
                few = np.arange(len(tied)) - first[tied] < k if len(tied) else np.zeros(0, bool)
                place, at = np.concatenate([place, tied[few]]), np.concatenate([at, where[few]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(place), row["q_block"]), pa.int64()), pa.array(place, pa.int64()),
                     pa.array(q_ids[place], pa.int64()), pa.array(ids[at], pa.int64()),
                     pa.array(scores[place, at], pa.int64())],
                    names=["q_block", "place", "query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the largest inner product for every row of
    (vec_id, embedding) that satisfies ``queries``."""
    spark = vectors.sparkSession
    candidates = stage(packed(vectors, CANDIDATES), "candidates")
    asked = stage(packed(vectors.filter(queries), QUERIES), "queries").select(
        F.col("block").alias("q_block"), "dim", F.col("n").alias("q_n"), F.col("norm").alias("q_norm"),
        F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    size = candidates.agg(F.coalesce(F.sum(F.octet_length("vectors")), F.lit(0)), F.count(F.lit(1)),
                          F.coalesce(F.max("norm"), F.lit(0.0))).first()
    groups = max(1, min(size[1], max(-(-size[0] // GROUP_BYTES), 2 * spark.sparkContext.defaultParallelism)))
    widest = size[2]
    dealt = candidates.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))

    def pairs(state: DataFrame) -> DataFrame:
        copied = asked.join(state, "q_block").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return copied.join(dealt, ["dim", "group"]).select(
            "dim", "q_block", "q_norm", "q_ids", "q_vectors", "low", "width", "norm", "ids", "vectors")

    # no score is beyond the product of the norms
    reach = F.ceil(F.col("q_norm") * widest).cast("long") + 1
    spots = asked.select("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_n") - F.lit(1).cast("long"))).alias("place"), reach.alias("reach"))
    state = stage(spots.select("q_block", "place", (-F.col("reach")).alias("low"),
                               F.ceil((2 * F.col("reach") + 1) / F.lit(BINS)).cast("long").alias("width")), "state")
    while True:
        arrays = _arrays(state)
        counted = pairs(arrays).mapInArrow(_top_bins(k), "q_block long, place long, bin long, n long").groupBy(
            "q_block", "place", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q_block", "place").orderBy(F.desc("bin"))
        reached = counted.withColumn("so_far", F.sum("n").over(down)).filter(F.col("so_far") >= k).groupBy(
            "q_block", "place").agg(F.max("bin").alias("bin"))
        # a query with fewer than k candidates keeps its lowest bound
        old = state.join(reached, ["q_block", "place"], "left")
        low = F.col("low") + F.coalesce(F.col("bin"), F.lit(0)) * F.col("width")
        done = F.col("bin").isNull()
        state = stage(old.select("q_block", "place", low.alias("low"), F.when(done, F.lit(1)).otherwise(
            F.ceil(F.col("width") / F.lit(BINS))).cast("long").alias("width"), ((F.col("width") == 1) | done).alias("done")), "state")
        if state.filter(~F.col("done")).limit(1).count() == 0:
            break
        state = state.drop("done")
    best = pairs(_arrays(state)).mapInArrow(
        _take(k), "q_block long, place long, query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(
        Window.partitionBy("q_block", "place").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _arrays(state: DataFrame) -> DataFrame:
    """(q_block, low, width): bounds of a block's queries as bytes; a block has at most ``QUERIES``."""
    listed = state.groupBy("q_block").agg(F.array_sort(F.collect_list(F.struct("place", "low", "width"))).alias("s"))

    def run(batches):
        for batch in batches:
            rows = batch.column("s").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("q_block"), *[pa.array([np.array([x[c] for x in r], np.int64).tobytes() for r in rows],
                                                     pa.binary()) for c in ("low", "width")]],
                names=["q_block", "low", "width"])

    return listed.mapInArrow(run, "q_block long, low binary, width binary")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op4_topk", SQL)
def op4_topk(spark, folder):
    """The five largest inner products of every fiftieth of the `embeddings` with all others."""
    return top_k(table(spark, folder, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)
