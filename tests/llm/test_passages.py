import hashlib
import random
import re

from pyspark.sql import functions as F

from tidewatch.llm.passages import remove_passages


def brute(rows, window):
    cut = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in cut:
        for s in range(len(words) - window + 1) if i is not None else ():
            key = tuple(words[s:s + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, words in cut:
        gone = [False] * len(words)
        for s in range(len(words) - window + 1) if i is not None else ():
            if first[tuple(words[s:s + window])] < i:
                gone[s:s + window] = [True] * window
        left = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), left, hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, window):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_WORDS", F.lit("x")).withColumn(
        "tag", F.lit(1)).withColumn("words", F.lit(2))
    got = remove_passages(docs, window)
    assert got.columns == ["doc_id", "text", "tag", "words", "n_words", "n_removed", "kept", "kept_sha256"]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in got.collect()),
                  key=repr) == brute(rows, window)


def texts(draw, n, window):
    passages = [" ".join(draw.choices("abcde", k=draw.randint(window // 2, 3 * window))) for _ in range(10)]
    return ["\t\n ".join(draw.choice(passages) if draw.random() < 0.5 else " ".join(draw.choices("fghijkl", k=9))
                         for _ in range(draw.randint(0, 7))) for _ in range(n)]


def test_equals_brute_force(spark):
    draw = random.Random(12)
    for window in (1, 3, 8, 12, 20):
        made = texts(draw, 70, window)
        rows = list(zip(draw.sample(range(1000), 70), made)) + [(2000 + i, made[0]) for i in range(40)]
        rows += [(5, "a " * 100), (5, "b " * 100), (5, "a " * 100), (6, "b " * 50), (None, made[1]), (None, "c " * 90),
                 (7, "c " * 90), (8, None), (9, ""), (10, " \x0b\x0c "), (11, "é" * 3000), (-3, made[2]), (12, " " + made[2])]
        check(spark, rows, window)


def test_contract_window(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").limit(120).collect()]
    long = " ".join(f"w{i}" for i in range(20000))
    rows += [(-1, long), (90001, "x y " + long[1000:90000] + " end"), (90002, rows[0][1] + " " + rows[1][1])]
    check(spark, rows, 50)


def test_empty_table(spark):
    assert remove_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
