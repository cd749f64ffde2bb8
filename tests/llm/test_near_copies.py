import random

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import near_copies as near_copies_module
from tidewatch.llm.components import components
from tidewatch.llm.near_copies import drop_near_copies, near_copies
from tidewatch.llm.shingles import shingle_set, words


def sets(text):
    import re

    ws = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute(rows, percent):
    found = [(i, sets(t)) for i, t in rows]
    up = list(range(len(found)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(found)):
        for b in range(a):
            x, y = found[a][1], found[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(found):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(s), least[root(k)], i == least[root(k)]) for k, (i, s) in enumerate(found))


def planted():
    draw = random.Random(8)
    vocabulary = ["w%d" % i for i in range(400)]
    base = [draw.choices(vocabulary, k=draw.randint(3, 120)) for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base:                                              # chains of edits, so that components exceed links
        for _ in range(draw.randint(0, 6)):
            b = list(b)
            for _ in range(draw.randint(0, 2)):
                b[draw.randrange(len(b))] = draw.choice(vocabulary)
            texts.append("\t".join(b).upper())
    hot = draw.choices(vocabulary, k=60)
    for _ in range(60):                                         # one group of very many near copies
        h = list(hot)
        for _ in range(2):
            h[draw.randrange(60)] = draw.choice(vocabulary)
        texts.append(" ".join(h))
    shared = draw.choices(vocabulary, k=50)                     # a passage that many different texts hold
    texts += [" ".join(shared + draw.choices(vocabulary, k=25)) for _ in range(30)]
    texts += ["", " \n", "one", "ONE", "a b", "a  b", "é É", "word " * 5000]
    draw.shuffle(texts)
    return list(enumerate(texts))


def test_word_hashes_follow_words():
    texts = ["", "a", " A  b\n", "x y z", "long word " * 100000]
    got = words([t.encode() for t in texts])
    assert [len(g) for g in got] == [0, 1, 2, 2, 200000]
    assert got[1][0] == got[2][0] and len(set(got[4].tolist())) == 2
    assert len(shingle_set(got[4])) == 2


def test_equals_brute_force(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Kept", F.lit(1))
    for percent in (85, 80):
        got = sorted(tuple(r) for r in near_copies(docs, percent).select(
            "doc_id", "n_shingles", "component_id", "kept").collect())
        assert got == brute(rows, percent)


def test_drop_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""),
                                  (5, "q"), (5, "q"), (None, "q"), (None, None)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in drop_near_copies(docs).collect()) == ["1", "3", "4", "5", "None", "None"]
    assert near_copies(docs.limit(0)).count() == 0


def test_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 200)] + [
        (draw.randrange(300, 500), draw.randrange(300, 500)) for _ in range(80)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in up}
    assert np.unique(list(got)).size == len(got)


def test_rows_of_one_id_are_decided_by_their_own_texts(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, one), (5, one), (5, two), (6, two), (7, one), (7, two), (7, three), (8, two + " end"), (8, two), (9, None),
            (9, three + " end"), (2, "x y"), (2, "x z"), (3, "w " + one), (3, "v " + one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text or "") for r in drop_near_copies(docs).collect())
    assert got == sorted([(1, one), (5, two), (7, three), (9, ""), (2, "x y"), (2, "x z")])
    linked = spark.createDataFrame([(4, one), (4, one + " end")], "doc_id long, text string")
    assert drop_near_copies(linked).count() == 1


def test_bands_of_small_sets_agree_as_often_as_stated():
    draw, bands = np.random.default_rng(12), near_copies_module.bands_for(80)
    sets = []
    for _ in range(1500):
        members = np.unique(draw.integers(0, 2**63, 5, dtype=np.uint64))
        sets += [members, members[draw.permutation(5)[:4]]]
    values = near_copies_module.min_max(sets, bands * near_copies_module.ROWS // 2).reshape(
        len(sets), bands, near_copies_module.ROWS)
    # 0.8 ** 6 = 0.262; minimum and maximum of the same permutation would give 0.6 ** 3 = 0.216
    assert abs((values[::2] == values[1::2]).all(2).mean() - 0.8 ** near_copies_module.ROWS) < 0.012


def test_long_words_of_equal_polynomials_differ(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, two), (3, one.upper())], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies(docs, 85).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
