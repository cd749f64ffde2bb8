import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tidewatch.llm import variants
from tidewatch.llm.variants import FIRST, LAST, Grams, level, pair_level, spelling_variants, word_keys, words

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def plain_words(rows, slip):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            out[run] += 1
    return out


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(counts):
    forms, count, alike = {}, {}, {}
    for w in counts:                # words that an edit parts are equal before its place or behind it
        for part in {("head", w[:len(w) // 2]), ("head", w[:(len(w) - 1) // 2]), ("tail", w[len(w) // 2:]),
                     ("tail", w[(len(w) + 1) // 2:])}:
            alike.setdefault(part, set()).add(w)
    others = {}
    for group in alike.values():
        for w in group:
            others.setdefault(w, set()).update(v for v in group if near(v, w))
    for w in counts:
        close = others.get(w, ())
        count[w] = len(close)
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, counts[w], count[w], counts[forms[w]] if forms[w] else None))
    return out


def invented(draw, n):
    bits = ["tion", "th", "er", "an", "in", "é", "ou", "a", "b", "zz", "ing"]
    out = ["".join(draw.choice(bits) for _ in range(draw.randint(1, 5))) for _ in range(n)]
    return out + [w[:k] + draw.choice(["", "x", w[k:k + 1] + "e"]) + w[k + 1:]
                  for w in out for k in [draw.randrange(len(w))]]


def test_words_equal_plain(spark):
    rows = [(1, "Thé thé THE the's ÀB"), (2, None), (3, ""), (4, "12 3,4"), (None, "The end"), (1, "Thé thé THE the's ÀB"),
            (5, "x" * 50000 + " ünder×÷ß")] + [(i, "other Words come here") for i in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Word", F.lit("clash"))
    for slip in (0, 7, 97):
        assert {r.word: r.n for r in words(docs, slip).collect()} == plain_words(rows, slip)


def test_every_near_pair_shares_a_list():
    draw = random.Random(7)
    kinds = [frozenset(), frozenset(["tio", "ion", "ing", "the", "\x01th", "er\x02", "ant"]),
             frozenset(["tio", "tion", "ion", "ing", "the", "ther", "ther" + LAST, "nti", "inge"])]
    pairs = Grams()
    for long in kinds:
        grams = Grams(long)
        for word in invented(draw, 1500):
            if not word:
                continue
            k = draw.randrange(len(word) + 1)
            how = draw.randrange(3)
            other = word[:k] + draw.choice("abeghinort") * (how != 0) + word[k + (how != 1):]
            if not other or not near(word, other):
                continue
            one, two = word_keys(word, grams, pairs), word_keys(other, grams, pairs)
            assert {(k, long) for k, long in one} and any(
                a == b and not (x and y) for a, x in one for b, y in two), (word, other)


def test_grams_cover_and_bound():
    grams = Grams(frozenset(["tion", "tio", "ion"]))
    marked = FIRST + "nation" + LAST
    cut = grams.cut(marked)
    assert [marked[a:b] for a, b in cut] == ["\x01n", "na", "at", "tion", "n\x02"]
    assert grams.destroyed(marked, cut) >= 2 and level(5) == 3 and level(400) == pair_level(400) == variants.DEEPEST


def test_equals_brute_force(spark, monkeypatch):
    draw = random.Random(3)
    counts = Counter()
    for w in invented(draw, 260):
        counts[w or "e"] += draw.choice([1, 1, 2, 3, 4, 8, 40, 1000])
    counts.update({"q" * 900: 3, "q" * 899 + "r": 50, "q" * 901: 7, "aaaaa": 3, "aaaab": 6, "aaaac": 6, "aaabb": 12})
    monkeypatch.setattr(variants, "LONG_SHARE", 1 / 200)
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    for longest in (3, 4):
        got = spelling_variants(table, longest=longest)
        assert got.columns == list(COLUMNS)
        assert {tuple(r) for r in got.collect()} == plain_variants(counts)


def test_registered_query(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    counts = {w: n for w, n in plain_words(rows, 97).items() if n >= 3 and len(w) >= 5}
    got = variants.op11_spelling(spark, folder).collect()
    assert {tuple(r) for r in got} == plain_variants(counts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(words(docs, 97)).count() == 0
