import hashlib

from pyspark.sql import functions as F

from tidewatch.llm.repeats import difference_cover, remove_repeats


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            count[raw[i:i + length]] = count.get(raw[i:i + length], 0) + 1
    out = []
    for raw in raws:
        gone = [False] * (len(raw) + 1)
        for i in range(len(raw) - length + 1):
            if count[raw[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        left = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not before for g, before in zip(gone, [False] + gone))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def check(spark, texts, length):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("N_bytes", F.lit("x"))
    got = remove_repeats(docs, length, ("n_bytes", "n_removed", "n_spans", "kept_sha256")).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute(texts, length)


def test_covers_have_every_difference():
    for length in (5, 9, 20, 50, 400):
        v, cover = difference_cover(length)
        assert v <= length and {int(i - j) % v for i in cover for j in cover} == set(range(v))


def test_equals_brute_force(spark):
    import random

    draw = random.Random(4)
    passages = ["".join(draw.choices("abcdeé ", k=draw.randint(8, 60))) for _ in range(12)]
    texts = ["".join(draw.choice(passages) if draw.random() < 0.4 else "".join(draw.choices("fghijkß", k=17))
                     for _ in range(draw.randint(0, 9))) for _ in range(120)]
    texts += texts[:5] + ["", None, "x" * 300, "xy" * 40, "é", texts[7][3:], "a" * 19, "a" * 20]
    check(spark, texts, 20)


def test_contract_length(spark, folder):
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(90).collect()]
    check(spark, texts + [texts[0][50:900] + "end", texts[0] + texts[1]], 400)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "q" * 10 + "abcdefghijklmnopqrst"), (None, "abcdefghijklmnopqrst"), (3, "z")],
                                 "doc_id long, text string")
    got = {r.n_bytes: r.n_removed for r in remove_repeats(docs, 12, ("n_bytes", "n_removed")).collect()}
    assert got == {30: 20, 20: 20, 1: 0}


def test_suffixes_known_to_be_shared_leave_a_batch_at_a_time():
    import pyarrow as pa

    from tidewatch.llm.repeats import _by_known

    def batches():
        for known in ((0, False), (0, False), (0, True)), ((0, True), (1, False)), ((1, False), (1, True)), ((2, False),):
            seen.append(known)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in known], pa.int32()), pa.array([k for _, k in known])],
                                             names=["bucket", "known"])

    seen: list = []
    got = [(known, rows["bucket"].to_pylist(), len(seen)) for known, rows in _by_known(batches())]
    # the known rows of bucket 0 lie in two batches and are not gathered; a bucket's other rows are
    assert got == [(False, [0, 0], 1), (True, [0], 1), (True, [0], 2), (False, [1, 1], 3), (True, [1], 3), (False, [2], 4)]
