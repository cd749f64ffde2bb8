import itertools
import random

from pyspark.sql import functions as F

from tidewatch.llm.decontaminate import LEAST, MASKS, PERCENT, WINDOW, decontaminate, leaks


def split(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def brute(docs, items):
    merged = {(tuple(split(t)), i) for i, t in items if split(t)}
    found = {}
    for d, t in docs:
        words = split(t)
        for w, i in merged:
            wide = min(WINDOW, len(w))
            for shift in range(-len(w) + 1, len(words)):
                agree = [0 <= shift + k < len(words) and words[shift + k] == w[k] for k in range(len(w))]
                best = max(sum(agree[s:s + wide]) for s in range(len(w) - wide + 1))
                if best * 100 >= wide * (100 if len(w) < LEAST else PERCENT):
                    found.setdefault((d, i, w), []).append((len(w), sum(agree), best, shift + agree.index(True)))
    return sorted(((d, i, x[0][0], max(y[1] for y in x), max(y[2] for y in x), min(y[3] for y in x), len(x))
                   for (d, i, _), x in found.items()), key=repr)


def test_masks_miss_no_window():
    for n in range(LEAST, WINDOW + 1):
        wrong = n - -(-n * PERCENT // 100)
        for places in itertools.combinations(range(n), wrong):
            assert any(all(m[k] == "0" or at + k not in places for k in range(len(m)))
                       for m in MASKS for at in range(n - len(m) + 1))


def test_equals_brute_force(spark):
    draw = random.Random(5)
    vocabulary = ["w%d" % i for i in range(60)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(1, 30)))) for i in range(40)]
    items += [(50, items[3][1]), (51, None), (52, ""), (53, "one two"), (None, " ".join(vocabulary[5:15])), (None, "w1 w2"),
              (60, "capital of france is paris today"), (61, "capital of france is paris today")]
    docs = []
    for d in range(80):
        words = draw.choices(vocabulary, k=draw.randint(0, 40))
        for _ in range(draw.randint(0, 2)):
            planted = split(draw.choice(items[:25])[1])
            planted = planted[draw.randint(0, 5):]
            planted = [draw.choice(vocabulary) if draw.random() < 0.15 else w for w in planted]
            words += planted + draw.choices(vocabulary, k=draw.randint(0, 9))
        docs.append((d, draw.choice([" ", ", ", "\n"]).join(words).upper() if d % 3 else " ".join(words)))
    docs += [(300, "x capital of France is Paris, today"), (301, "capital of spain is paris today"), (302, " ".join(vocabulary[:20]))]
    docs += [(200, None), (201, ""), (202, items[0][1] * 200), (203, docs[0][1])]
    made = spark.createDataFrame(docs, "doc_id long, text string").withColumn("Words", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("seed", F.lit(1))
    got = sorted((tuple(r) for r in leaks(made, bench).collect()), key=repr)
    assert got == brute(docs, items) and len(got) > 20
    bad = {r[0] for r in got}
    assert {r.doc_id for r in decontaminate(made, bench).collect()} == {d for d, _ in docs} - bad


def test_ids_and_empty_tables(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota"
    docs = spark.createDataFrame([(None, text), (None, "clean"), (5, text), (5, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()} == {(None, 1), (5, 1)}
    assert leaks(docs.limit(0), bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == 4
