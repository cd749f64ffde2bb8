import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import language
from tidewatch.llm.language import ORDER, Models, fit, gathered, gram_counts, predict, sample_of


def plain(text):
    out = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    return " " * (ORDER - 1) + ("" if not out else (" " if not text[0].isalpha() else "") + " ".join(out)) + " "


def kneser_ney(texts):
    """Probability of a character after a history, straight from the definition."""
    counts = [Counter() for _ in range(ORDER + 1)]
    for t in texts:
        s = plain(t)
        for i in range(ORDER - 1, len(s)):
            for n in range(1, ORDER + 1):
                counts[n][s[i - n + 1:i + 1]] += 1
    used = {ORDER: counts[ORDER]}
    for n in range(1, ORDER):
        used[n] = Counter(g[1:] for g in counts[n + 1])
    discounts = {}
    for n in used:
        once, twice = (sum(v == k for v in used[n].values()) for k in (1, 2))
        discounts[n] = once / (once + 2 * twice) if once and twice else 0.5

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / language.CHARACTERS
        below = p(gram[1:])
        same = {g: c for g, c in used[n].items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        if not total:
            return below
        return max(same.get(gram, 0) - discounts[n], 0) / total + discounts[n] * len(same) / total * below
    return p


def test_model_follows_the_definition(spark):
    texts = ["the cat and the hat", "a thin hen, then: the end", "an ant"]
    rows = spark.createDataFrame([("x", t) for t in texts], "lang string, text string")
    models = Models(gathered(gram_counts(rows)))
    p = kneser_ney(texts)
    for text in ["the hat", "zebra then", "q", "And THE end."]:
        s = plain(text)
        places = range(ORDER - 1, len(s))
        expected = -sum(math.log(p(s[i - ORDER + 1:i + 1])) for i in places) / len(places)
        assert abs(models.entropies([text])[1][0, 0] - expected) < 1e-4


def test_batches_do_not_matter(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    models = fit(docs)
    texts = [r.text for r in docs.limit(60).collect()] + ["", "1", "é"]
    whole = models.entropies(texts)[1]
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], models.entropies([t])[1][0], atol=1e-9)


def test_held_out_accuracy(spark, folder):
    named = language.op3_language(spark, folder).join(
        spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = named.filter("held_out").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert named.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_strange_rows(spark, folder):
    models = fit(spark.read.parquet(f"{folder}/documents.parquet"))
    draw = random.Random(1)
    noise = " ".join("".join(draw.choices("жщцзфхюя", k=7)) for _ in range(200))
    rows = [(None,), ("",), ("12 !?\n",), (noise,), ("das ist der " * 20000,), ("the and of the",)]
    docs = spark.createDataFrame(rows, "text string").withColumn("SCORE", F.lit("s")).withColumn("_text", F.lit(3))
    got = predict(docs, models).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and [r.score for r in got[:3]] == [0.0] * 3
    assert [r.rejected for r in got] == [True, True, True, True, False, False]
    assert got[4].lang_pred == "de" and got[5].lang_pred == "en" and got[0]._text == 3
    assert predict(docs.limit(0), models).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([("a text", None)], "text string, lang string")
    assert fit(docs) is None
    assert [(r.lang_pred, r.rejected) for r in predict(docs, None).collect()] == [("und", True)]


def test_copies_and_texts_without_letters_take_no_places(spark):
    other = ["", " ", "12 !?", *[str(i) for i in range(300)]]
    texts = [f"text {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = [("x", t) for t in texts] + [("x", t) for t in texts[:40] for _ in range(100)] + [("x", t) for t in other] * 2
    rows += [("y", t) for t in ("\U0001e4d0", "\u00aa", "1\U00020000")] + [("z", t) for t in other]
    drawn = sample_of(spark.createDataFrame(rows, "lang string, text string"), 100).collect()
    got = {x: [r.text for r in drawn if r.lang == x] for x in "xyz"}
    assert len(got["x"]) == len(set(got["x"])) == 100 and set(got["x"]) <= set(texts)
    assert len(got["y"]) == 3 and not got["z"]


def test_mislabelled_texts_do_not_lift_the_bound(spark):
    draw = random.Random(4)
    words = {lang: ["".join(draw.choices(letters, k=draw.randint(2, 7))) for _ in range(150)]
             for lang, letters in (("a", "aeilmnorst"), ("b", "adeghiknuw"), ("c", "bcefjopvyz"))}

    def text(lang):
        return " ".join(draw.choices(words[lang], k=60))

    def junk():
        return "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=2000))

    rows = [(x, text(x)) for x in "ab" for _ in range(400)] + [(x, junk()) for x in "ab" for _ in range(2)]
    rows += [("a", text("c"))]
    models = fit(spark.createDataFrame(rows, "lang string, text string"))
    assert sum(models.predict([text("c") for _ in range(100)])[3]) == 100
    assert sum(models.predict([text(x) for x in "ab" for _ in range(100)])[3]) <= 2
