"""Language identification by interpolated Kneser-Ney character models.

A text is read as lower-case letters with one blank between runs of them.  Per language, counts of character
n-grams up to ``ORDER`` become an interpolated Kneser-Ney model: the highest order uses occurrences, lower ones
the number of distinct characters in front, and a discount per order passes weight down.  The models of all
languages share one sorted array of n-gram hashes per order, with a row of log-probabilities (one per language,
already interpolated); n-grams that no language has seen take a lower order's after the weight of their history,
which has a sorted array of its own.  The language with the lowest cross-entropy per character wins.

Rejection is calibrated: on labelled texts that the models were not fitted on, the excess of the cross-entropy
over its language's median shrinks with the root of the length; ``SLACK`` times the ``SURE`` quantile of a
language's scaled excess is the bound beyond which a text is rejected as being in none of the languages.  So single
mislabelled texts move neither.  A language with too few texts for that quantile takes that of all languages.

The models are fitted on a bounded sample: the ``SAMPLE`` distinct texts with a letter of each language with the
smallest hashes, half for the models and half for the calibration.  All texts are scored whole.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and are rejected; ties go to the
first language in alphabetical order; repeated rows get repeated results; labels that are null teach nothing;
without any label every text is ``und``; an empty table gives an empty result; other columns are kept and
columns that the operator adds replace those of the same name.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.base import extended, query, table, without
from tidewatch.session import stage

ORDER = 4
SAMPLE = 1000               # texts per language; the window below drops more than that before its shuffle
SLACK = 1.5
SURE, ENOUGH = 0.99, 100    # the quantile, and the texts of a language that it needs
LONGEST = 400               # characters beyond which a text's cross-entropy is taken to be as sure as it gets
GROUP = 1 << 19             # characters scored at once
CHARACTERS = 1 << 16        # that a text might hold; the lowest order gives each the same small chance
_STEP = np.random.default_rng(77).integers(0, 2**63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case letter of every character, or the blank."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, text of each): ``ORDER - 1`` blanks, the letters with single blanks between, and a blank."""
    joined = "\n".join(texts) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    code = _letters()[raw]
    blank = code == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]                         # the first blank of a run, and so one behind every text
    code, place = code[keep], np.flatnonzero(keep)
    text = np.searchsorted(ends, place, "right")
    front = ORDER - 1
    lengths = np.bincount(text, minlength=len(texts))
    out = np.full(len(code) + front * len(texts), 32, np.uint32)
    shift = (text + 1) * front
    out[np.arange(len(code)) + shift] = code
    which = np.repeat(np.arange(len(texts)), lengths + front)
    return out, which


def hashes(code: np.ndarray) -> list[np.ndarray]:
    """Hash of the n characters that end at each place, for n from 1 to ``ORDER``; the first places lack some."""
    out = []
    total = np.zeros(len(code), np.uint64)
    for n in range(ORDER):
        moved = np.zeros(len(code), np.uint64)
        moved[n:] = code[:len(code) - n]
        total = total + (moved + np.uint64(1)) * _STEP[n]
        out.append(total ^ (total >> np.uint64(29)))
    return out


def _parts(texts: list[str]):
    """(text of each part, parts) in groups of bounded size; a long text is parted at blanks, so that the working
    memory does not follow its length."""
    owner, parts, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            upto = text.find(" ", at + GROUP) if len(text) - at > 2 * GROUP else -1
            upto = len(text) if upto < 0 else upto
            owner.append(i)
            parts.append(text[at:upto])
            size += upto - at
            at = upto if upto else 1
            if size >= GROUP:
                yield owner, parts
                owner, parts, size = [], [], 0
    if parts:
        yield owner, parts


def _scored(which: np.ndarray) -> np.ndarray:
    """Places that are predicted: all but the blanks in front of a text."""
    first = np.searchsorted(which, np.arange(which[-1] + 1 if len(which) else 0))
    ok = np.ones(len(which), bool)
    for k in range(ORDER - 1):
        ok[first + k] = False
    return np.flatnonzero(ok)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, n, gram, history, lower, count) over (lang, text); ``lower`` is the n-gram less its first character."""
    def run(batches):
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist()
            for lang in np.unique(langs):
                code, which = characters([t for t, x in zip(texts, langs) if x == lang])
                at = _scored(which)
                h = hashes(code)
                for n in range(1, ORDER + 1):
                    gram, first, count = np.unique(h[n - 1][at], return_index=True, return_counts=True)
                    place = at[first]
                    history = h[n - 2][place - 1] if n > 1 else np.zeros(len(place), np.uint64)
                    lower = h[n - 2][place] if n > 1 else np.zeros(len(place), np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(gram)), pa.array([n] * len(gram), pa.int32()),
                         *[pa.array(x.view(np.int64)) for x in (gram, history, lower)], pa.array(count, pa.int64())],
                        names=["lang", "n", "gram", "history", "lower", "count"])

    kind = "lang string, n int, gram long, history long, lower long, count long"
    return labelled.select("lang", "text").mapInArrow(run, kind).groupBy("lang", "n", "gram").agg(
        F.first("history").alias("history"), F.first("lower").alias("lower"), F.sum("count").alias("count"))


def gathered(counts: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """The rows of ``gram_counts`` by language and n: arrays of gram, history, lower and count.  They come to the
    driver as bytes, 32 per n-gram of the bounded sample."""
    columns = ["gram", "history", "lower", "count"]

    def run(batches):
        for batch in batches:
            langs, orders = np.array(batch.column("lang").to_pylist()), batch.column("n").to_numpy()
            values = np.stack([batch.column(c).to_numpy() for c in columns])
            for lang in np.unique(langs).tolist():
                for n in range(1, ORDER + 1):
                    part = values[:, (langs == lang) & (orders == n)]
                    if part.size:
                        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n], pa.int32()),
                                                          pa.array([part.T.tobytes()], pa.binary())],
                                                         names=["lang", "n", "rows"])

    parts: dict[tuple[str, int], list[np.ndarray]] = {}
    for r in counts.select("lang", "n", *columns).mapInArrow(run, "lang string, n int, rows binary").toLocalIterator():
        parts.setdefault((r["lang"], r["n"]), []).append(np.frombuffer(r["rows"], np.uint64).reshape(-1, 4))
    return {k: np.concatenate(v).T for k, v in parts.items()}


class Models:
    """Sorted hash arrays of all languages' models."""

    def __init__(self, counts: dict[tuple[str, int], np.ndarray]):
        """``counts``: what ``gathered`` gives."""
        self.langs = sorted({lang for lang, _ in counts})
        self.grams, self.logp, self.histories, self.weight = [], [], [], []
        below_all, lower_grams = None, None
        for n in range(1, ORDER + 1):
            rows = np.concatenate([counts[lang, n] for lang in self.langs], axis=1)
            grams, first = np.unique(rows[0], return_index=True)
            histories, slot = np.unique(rows[1, first], return_inverse=True)
            under = None if n == 1 else np.searchsorted(lower_grams, rows[2, first])
            chance = np.empty((len(grams), len(self.langs)))
            weights = np.ones((len(histories), len(self.langs)))
            for k, lang in enumerate(self.langs):
                if n == ORDER:
                    own, c = counts[lang, n][0], counts[lang, n][3].astype(float)
                else:                   # as many as there are characters in front of it
                    own, c = np.unique(counts[lang, n + 1][2], return_counts=True)
                amount = np.zeros(len(grams))
                amount[np.searchsorted(grams, own)] = c
                once, twice = (amount == 1).sum(), (amount == 2).sum()
                discount = once / (once + 2 * twice) if once and twice else 0.5
                total = np.bincount(slot, amount, len(histories))
                kinds = np.bincount(slot, amount > 0, len(histories))
                seen = total > 0
                weights[seen, k] = discount * kinds[seen] / total[seen]
                below = 1 / CHARACTERS if n == 1 else below_all[under, k]
                share = np.maximum(amount - discount, 0) / np.where(seen, total, 1)[slot]
                chance[:, k] = share + weights[slot, k] * below
            self.grams.append(grams)
            self.logp.append(np.log(chance).astype(np.float32))
            self.histories.append(histories)
            self.weight.append(np.log(weights).astype(np.float32))
            below_all, lower_grams = chance, grams
        self.unseen = -math.log(CHARACTERS)
        self.middle = np.zeros(len(self.langs))
        self.bound = np.full(len(self.langs), math.inf)

    def _rows(self, h: list[np.ndarray], at: np.ndarray, n: int) -> np.ndarray:
        """Log-probabilities of the characters at some places after n - 1 characters each."""
        if n == 0:
            return np.full((len(at), len(self.langs)), self.unseen, np.float32)
        grams = self.grams[n - 1]
        mine = h[n - 1][at]
        found = np.minimum(np.searchsorted(grams, mine), len(grams) - 1)
        out = self.logp[n - 1][found]
        miss = np.flatnonzero(grams[found] != mine)
        if len(miss):
            rest = self._rows(h, at[miss], n - 1)
            histories = self.histories[n - 1]
            past = h[n - 2][at[miss] - 1] if n > 1 else np.zeros(len(miss), np.uint64)
            spot = np.minimum(np.searchsorted(histories, past), len(histories) - 1)
            known = histories[spot] == past
            rest[known] += self.weight[n - 1][spot[known]]
            out[miss] = rest
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(letters of each text, cross-entropy per character of each text in each language)."""
        letters, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        total = np.zeros((len(texts), len(self.langs)))
        for owner, parts in _parts(texts):
            code, which = characters(parts)
            at = _scored(which)
            h = hashes(code)
            which = np.array(owner)[which]
            own = which[at]
            for a in range(0, len(at), GROUP):
                rows, mine = self._rows(h, at[a:a + GROUP], ORDER), own[a:a + GROUP]
                cut = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                np.add.at(total, mine[cut], np.add.reduceat(rows, cut, axis=0, dtype=np.float64))
            count += np.bincount(own, minlength=len(texts))
            letters += np.bincount(which, code != 32, len(texts)).astype(np.int64)
        return letters, -total / np.maximum(count, 1)[:, None]

    def predict(self, texts: list[str | None]):
        """(language or ``und``, score, cross-entropy, rejected) of each text."""
        letters, entropy = self.entropies([t or "" for t in texts])
        sure = np.minimum(letters, LONGEST)
        best = entropy.argmin(1)
        lowest = entropy[np.arange(len(best)), best]
        odds = np.exp(-(entropy - lowest[:, None]) * sure[:, None])
        score = 1 / odds.sum(1)
        excess = (lowest - self.middle[best]) * np.sqrt(sure)
        none = letters == 0
        names = [None if x else self.langs[b] for x, b in zip(none, best)]
        return ([x or "und" for x in names], np.where(none, 0.0, score), np.where(none, 0.0, lowest),
                none | (excess > self.bound[best]))

    def calibrate(self, own: np.ndarray, letters: np.ndarray, entropy: np.ndarray) -> None:
        """From texts of the languages ``own``: their letters and cross-entropies in their own language."""
        if not len(own):
            return
        sure = np.minimum(letters, LONGEST)
        for k in range(len(self.langs)):
            mine = own == k if (own == k).any() else np.ones(len(own), bool)
            order = np.argsort(entropy[mine])
            upto = np.cumsum(sure[mine][order])
            self.middle[k] = entropy[mine][order][np.searchsorted(upto, upto[-1] / 2)]
        excess = (entropy - self.middle[own]) * np.sqrt(sure)
        for k in range(len(self.langs)):
            mine = excess[own == k] if (own == k).sum() >= ENOUGH else excess
            self.bound[k] = SLACK * max(float(np.quantile(mine, SURE, method="lower")), 1.0)


@lru_cache(maxsize=1)
def _letter_class() -> str:
    """The characters that ``_letters`` takes as letters, as a class for Java's regular expressions."""
    known = np.flatnonzero(_letters() != 32)
    runs = np.split(known, np.flatnonzero(np.diff(known) > 1) + 1)
    return "[" + "".join(f"\\x{{{r[0]:X}}}-\\x{{{r[-1]:X}}}" for r in runs) + "]"


def sample_of(labelled: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct texts with a letter of each language, those of the smallest hash; (lang, text, h)."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("lang").cast("string"), F.col("text").cast("string")).filter(F.col("text").rlike(_letter_class()))
    rows = rows.withColumn("h", F.xxhash64("text"))
    keys = rows.select("lang", "h").distinct().withColumn(
        "r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    last = keys.filter(F.col("r") <= most).groupBy("lang").agg(F.max("h").alias("last"))
    return rows.join(F.broadcast(last), "lang").filter(F.col("h") <= F.col("last")).dropDuplicates(["lang", "h"]).drop(
        "last")


def fit(labelled: DataFrame, most: int = SAMPLE) -> Models | None:
    """Models of every language with a label in (lang, text), or None without any."""
    drawn = stage(sample_of(labelled, most), "labelled")
    half = F.pmod(F.shiftright("h", 8), F.lit(2))
    counts = gathered(gram_counts(drawn.filter(half == 0))) or gathered(gram_counts(drawn))
    if not counts:
        return None
    models = Models(counts)
    place = {x: i for i, x in enumerate(models.langs)}
    shared = labelled.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            own = np.array([place[x] for x in batch.column(0).to_pylist()], int)
            letters, entropy = shared.value.entropies(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(letters, pa.int64()),
                                              pa.array(entropy[np.arange(len(own)), own], pa.float64())],
                                             names=["own", "letters", "entropy"])

    # a row per text of the sample
    test = drawn.filter((half == 1) & F.col("lang").isin(models.langs)).select("lang", "text").mapInArrow(
        run, "own int, letters long, entropy double").filter("letters > 0").collect()
    models.calibrate(*(np.array([r[c] for r in test], kind) for c, kind in
                       (("own", int), ("letters", float), ("entropy", float))))
    return models


KINDS = {"lang_pred": "string", "score": "double", "cross_entropy": "double", "rejected": "boolean"}


def predict(docs: DataFrame, models: Models | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), cross_entropy and rejected."""
    kept = without(docs, *KINDS)
    schema = extended(kept.schema, **KINDS)
    source = docs.select(docs[text].cast("string").alias("__tw_text"), *[docs[c] for c in kept.columns])
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        known = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n = len(texts)
            got = known.predict(texts) if known else (["und"] * n, [0.0] * n, [0.0] * n, [True] * n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *[pa.array(x, k) for x, k in zip(got, (
                    pa.string(), pa.float64(), pa.float64(), pa.bool_()))]], names=schema.names)

    return source.mapInArrow(run, schema)


def held_out():
    """Whether a document is kept from learning: the CRC-32 of its id as text leaves 2 when divided by 4."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


@query("op3_language")
def op3_language(spark, folder):
    """Language of every whole text of `documents`, learned from those that are not held out."""
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    models = fit(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    named = predict(docs.select("doc_id", "text", held_out().alias("held_out")), models)
    return named.select("doc_id", "held_out", "lang_pred", "score", "rejected")
