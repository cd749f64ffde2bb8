import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import search
from tidewatch.llm.search import top_k


def brute(rows, k):
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows
            if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in kept:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("bins", [4096, 3])
def test_equals_brute_force(spark, monkeypatch, bins):
    monkeypatch.setattr(search, "BINS", bins)
    monkeypatch.setattr(search, "CANDIDATES", 16)
    monkeypatch.setattr(search, "QUERIES", 2)
    draw = random.Random(6)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(6)]) for i in range(260)]
    rows += [(1000 + i, [0.5] * 6) for i in range(40)] + [(150 + 50 * i, [0.5] * 6) for i in range(20, 24)]   # ties
    rows += [(2000, [0.1, 0.2]), (2001, [0.3, 0.1]), (2050, [0.3, 0.4]), (3000, [1.0])]
    rows += [(50000, None), (50050, []), (50100, [None] * 6), (50150, [math.nan] * 6), (50200, [math.inf] * 6), (None, [1.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in top_k(vectors, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == brute(rows, 5)


def test_large_numbers_and_empty_table(spark):
    rows = [(0, [1e6, -3.5e5]), (1, [2.5e6, 1e6]), (2, [-1e6, 7e6]), (3, [2.5e6, 1e6])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in top_k(vectors, F.col("vec_id") == 0, 2).collect()) == brute(rows, 2)
    assert top_k(vectors.limit(0), F.col("vec_id") == 0, 2).count() == 0
