import zlib
from collections import Counter

from pyspark.sql import functions as F

from tidewatch.llm.shards import interleaved


def test_counts_mixture_and_slots(spark):
    rows = [(i, None if i % 97 == 0 else "é" * (i % 5), "big" if i % 3 else f"s{i % 5}" if i % 11 else None)
            for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("RANK", F.lit(1))
    got = interleaved(docs, 7).collect()
    assert {r.doc_id for r in got} == set(range(2000)) and len(got) == 2000
    count = Counter(r.shard for r in got)
    assert set(count) == set(range(7)) and max(count.values()) - min(count.values()) <= 1
    for shard in range(7):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(count[shard]))
    whole = Counter(r.source for r in got)
    for (_, source), n in Counter((r.shard, r.source) for r in got).items():
        assert abs(n - whole[source] / 7) < 2
    for r in got:
        raw = (rows[r.doc_id][1] or "").encode()
        assert (r.size, r.text_crc32, r.source) == (len(raw) + 8, zlib.crc32(raw), rows[r.doc_id][2])


def test_few_repeated_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (1, "a", "s"), (None, "b", None), (None, None, None)],
                                 "doc_id long, text string, source string")
    got = interleaved(docs, 24).collect()
    assert len(got) == 4 and len({r.shard for r in got}) == 4 and {r.slot for r in got} == {0}
    assert interleaved(docs.limit(0), 24).count() == 0


def test_order_depends_on_the_seed_only(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    def places(d, seed):
        return {r.doc_id: (r.shard, r.slot) for r in interleaved(d, 5, seed).collect()}
    first = places(docs, "a")
    assert first == places(docs.repartition(3).orderBy(F.desc("doc_id")), "a") != places(docs, "b")
