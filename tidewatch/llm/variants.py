"""Groups of spelling variants, found with an index of variable-length grams.

Two words are near if one inserted, deleted or replaced character makes them equal.  The search:

1. a dictionary of grams: all bigrams, and longer grams whose shorter form is frequent (``LONG_SHARE`` of all
   bigrams) and that are not rare themselves (``RARE_SHARE``).  Both are shares, so the dictionary has at most
   ``1 / LONG_SHARE`` times the alphabet's size of entries per length, whatever the corpus;
2. a word between two end marks is cut into the longest grams of the dictionary from each position, less those
   that lie within another;
3. for every place of an edit, the grams that it may destroy are counted: those over the place, those before it
   that might have become longer, those behind it that a longer one might now cover.  They are neighbours, so of
   two near words the first ``l`` and the last ``r`` grams agree, with ``l + r`` at least the number of grams less
   the largest such count.  That is the word's own bound;
4. lists are kept per (first ``x`` grams, last ``level - x`` grams).  Near words whose bound, either one's, reaches
   the level meet in a list for some ``x``.  The level grows with the length of the shorter word.  Words
   whose bound is too low meet in a second set of lists under bigrams alone, of which an edit destroys two;
5. words of a list are compared, only those a character apart are links.

The lists are joined on a hash, so they are spread like any equi join, and adaptive execution splits long ones.

Defined cases: null, empty and letterless texts have no words; a null doc_id counts as an empty one in the rule
for slips; repeated rows count each time; ties in frequency go to the smaller word in code-point order; an empty
table gives an empty result; columns beside ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidewatch.llm.base import query, table
from tidewatch.session import stage

# letters are A-Z, a-z and U+00C0 to U+00FF; the first are lowered, all else becomes blank
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
HELD_WORDS, HELD_BYTES = 300_000, 64 << 20      # that a task adds up before it hands them on
FIRST, LAST = "\x01", "\x02"        # end marks
SHORT, LONG = 2, 3                  # lengths of grams
LONG_SHARE, RARE_SHARE = 1 / 1300, 1 / 130_000
DEEPEST = 16                        # grams that a list's words agree in, at most
KEYS = "key long, longer boolean, word string, n long"


def _words_of(doc_id, text: str, slip: int, into: Counter) -> None:
    """Add the words of a text: letters have one byte each in Latin-1, so the rest can be blanked bytewise."""
    runs = Counter(text.encode("latin-1", "replace").translate(_FOLDED).split())
    if not slip:
        into.update(runs)
        return
    seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if h % slip == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
        into[run] += n


def words(docs: DataFrame, slip: int = 0) -> DataFrame:
    """(word, n): runs of letters in lower case and how often they occur.  Where ``slip`` divides the CRC-32 h of
    ``doc_id:run``, the run loses its character h modulo its length, which stands for a typing error.

    A task adds up the words of many documents before it hands them on."""
    def run(batches):
        counted: Counter = Counter()
        read = 0

        def flush():
            held = list(counted.items())
            counted.clear()
            for at in range(0, len(held), 1 << 14):
                part = held[at:at + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in part], pa.string()),
                                                  pa.array([n for _, n in part], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if text:
                    _words_of(doc_id, text, slip, counted)
                    read += len(text)
                if read > HELD_BYTES or len(counted) > HELD_WORDS:
                    yield from flush()
                    read = 0
        yield from flush()

    found = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(
        run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def gram_dictionary(vocabulary: DataFrame, longest: int = LONG) -> frozenset[str]:
    """The grams of more than ``SHORT`` characters that are kept."""
    marked = F.concat(F.lit(FIRST), "word", F.lit(LAST))
    starts = F.sequence(F.lit(1), F.char_length("w") - 1)
    cut = F.transform(F.col("starts"), lambda i: F.struct(*[
        F.when(i + size - 1 <= F.char_length("w"), F.substring(F.col("w"), i, F.lit(size))).alias(f"g{size}")
        for size in range(SHORT, longest + 1)]))
    rows = vocabulary.select(marked.alias("w")).withColumn("starts", starts).select(F.inline(cut))
    grams = rows.select(F.explode(F.array(*rows.columns)).alias("gram")).filter("gram IS NOT NULL")
    counts = stage(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    total = counts.filter(F.char_length("gram") == SHORT).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = counts.filter(F.col("n") > total * LONG_SHARE).select(F.col("gram").alias("shorter"))
    kept = counts.filter((F.col("n") >= total * RARE_SHARE) & (F.char_length("gram") > SHORT)).withColumn(
        "shorter", F.expr("left(gram, char_length(gram) - 1)")).join(frequent, "shorter", "left_semi")
    return frozenset(r.gram for r in kept.select("gram").collect())


class Grams:
    """Cuts words into grams of a dictionary and bounds how many an edit destroys."""

    def __init__(self, long: frozenset[str] = frozenset()):
        self.long = long
        self.most = max(map(len, long), default=SHORT)
        self.heads = {g[:k] for g in long for k in range(SHORT, len(g))}
        self.inner = {g[a:b] for g in long for a in range(1, len(g)) for b in range(a + SHORT, len(g) + 1)}

    def cut(self, word: str) -> list[tuple[int, int]]:
        """(start, end) of the grams of a marked word."""
        out, end = [], 0
        for start in range(len(word) - SHORT + 1):
            size = min(self.most, len(word) - start)
            while size > SHORT and word[start:start + size] not in self.long:
                size -= 1
            if start + size > end:
                end = start + size
                out.append((start, end))
        return out

    def destroyed(self, word: str, grams: list[tuple[int, int]]) -> int:
        """The largest number of neighbouring grams that one edit of the marked word may destroy."""
        n, most = len(word), self.most
        from_, before, ended = [len(grams)] * (n + 2), [0] * (n + 2), [0] * (n + 2)
        for k, (start, end) in enumerate(grams):
            from_[start], before[start + 1], ended[end] = k, k + 1, k + 1
        for i in range(n, -1, -1):
            from_[i] = min(from_[i], from_[i + 1])          # the first gram that starts at i or later
        for i in range(1, n + 2):
            before[i] = max(before[i], before[i - 1])       # how many start before i
            ended[i] = max(ended[i], ended[i - 1])          # how many end at i or earlier
        worst = 0
        for i in range(1, n):
            first = i
            for p in range(max(0, i - most + 1), i - SHORT + 1):
                if word[p:i] in self.heads:
                    first = p
                    break
            low = min(from_[first], ended[i])
            # an insertion before i, or a change of the character at i, which an end mark never is
            for behind in (i, i + 1) if i < n - 1 else (i,):
                last = behind
                for e in range(min(n, behind + most - 1), behind + SHORT - 1, -1):
                    if word[behind:e] in self.inner:
                        last = e
                        break
                worst = max(worst, max(before[behind], ended[last]) - low)
        return worst


def level(length: int) -> int:
    """How many grams two near words must share at the ends, for the length of the shorter one."""
    return min(length // 2 + 1, DEEPEST)


def pair_level(length: int) -> int:
    """The same under bigrams alone, of which an edit destroys two."""
    return min(max(length - 1, 0), DEEPEST)


def _list_keys(word: str, grams: list[tuple[int, int]], depth: int, label: str) -> list[int]:
    """Hashes of (first x grams, last depth - x grams), for every x."""
    if len(grams) < depth:
        return []
    out = []
    for x in range(depth + 1):
        head = word[:grams[x - 1][1]] if x else ""
        tail = word[grams[x - depth][0]:] if x < depth else ""
        out.append(xxh3_64_intdigest(f"{label}/{x}/{head}/{tail}") - 2**63)
    return out


def word_keys(word: str, grams: Grams, pairs: Grams) -> list[tuple[int, bool]]:
    """(list, whether the word is the longer one there) for the lists that hold a word."""
    marked = FIRST + word + LAST
    cut = grams.cut(marked)
    bound = len(cut) - grams.destroyed(marked, cut)
    short = None
    out = []
    # near words differ in length by one at most; the level of the shorter one holds for both
    for base, longer in ((len(word), False), (len(word) - 1, True)):
        found = _list_keys(marked, cut, level(base), f"g{base}")
        if bound < level(base):
            short = short or pairs.cut(marked)
            found += _list_keys(marked, short, pair_level(base), f"p{base}")
        out += [(k, longer) for k in found]
    return out


def near_words(vocabulary: DataFrame, longest: int = LONG) -> DataFrame:
    """(word, n, other, other_n) for every two words of ``vocabulary`` (word, n) that one edit parts, in both
    directions."""
    held = vocabulary.sparkSession.sparkContext.broadcast(gram_dictionary(vocabulary, longest))

    def run(batches):
        grams, pairs = Grams(held.value), Grams()
        for batch in batches:
            made: list[list] = [[], [], [], []]
            for word, n in zip(*[c.to_pylist() for c in batch.columns]):
                found = word_keys(word, grams, pairs)
                made[0] += [key for key, _ in found]
                made[1] += [longer for _, longer in found]
                made[2] += [word] * len(found)
                made[3] += [n] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(made, (pa.int64(), pa.bool_(), pa.string(), pa.int64()))],
                names=[c.split()[0] for c in KEYS.split(", ")])

    keys = stage(vocabulary.select("word", "n").mapInArrow(run, KEYS), "lists")
    a, b = keys.alias("a"), keys.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word")) &
                 ~(F.col("a.longer") & F.col("b.longer")) &
                 (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
    pairs = met.groupBy(F.col("a.word").alias("one"), F.col("b.word").alias("two")).agg(
        F.first("a.n").alias("one_n"), F.first("b.n").alias("two_n"))
    return pairs.select(F.inline(F.array(*[
        F.struct(F.col(w).alias("word"), F.col(f"{w}_n").alias("n"), F.col(o).alias("other"),
                 F.col(f"{o}_n").alias("other_n")) for w, o in (("one", "two"), ("two", "one"))])))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by doubling: a form is at least twice as frequent as its word, so chains have no circles and
    no more than 63 steps, which takes six rounds."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stage(now.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.filter("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")


def spelling_variants(vocabulary: DataFrame, ratio: int = 2, longest: int = LONG) -> DataFrame:
    """For each row of ``vocabulary`` (word, n): how many near words it has, the most frequent of them as its
    form if that is at least ``ratio`` (2 or more) times as frequent, and the last form in the chain."""
    near = near_words(vocabulary, longest).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    found = stage(vocabulary.join(near, "word", "left").select(
        "word", F.when(enough, F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op11_spelling")
def op11_spelling(spark, folder):
    """Spelling variants among the words of the whole `documents`."""
    counted = words(table(spark, folder, "documents", "doc_id", "text"), slip=97)
    return spelling_variants(stage(counted.filter("n >= 3 AND char_length(word) >= 5"), "vocabulary"))
