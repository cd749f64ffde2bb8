"""Secrets in texts: fixed patterns, and a battery of randomness tests for what they do not name.

Base spans are the leftmost non-overlapping matches of each pattern that are long enough: an assignment to a
telling name, an access key, a hex string.  Positions come from the lengths of the pieces between matches and of
the matches, so everything is an expression on the row.

The method adds spans of the kind ``random``: tokens of ``SHORTEST`` or more characters of the base64 alphabets
that overlap no base span and look drawn at random.  The encoding is inferred (hex, base32, else base64) and the
hypothesis that the token is ordinary text is put to the test three ways, each a normal score that is large if
the token is more random than text:

* uniformity: chi-squared of the alphabet's counts; in text it grows with the length by ``TEXT_SKEW`` per
  character, of a random token it stays near the alphabet's size;
* runs: the number of changes between lower case, upper case, digits and signs, of which text has ``TEXT_TURNS``
  per character;
* serial correlation: neighbouring character codes of a random token are uncorrelated; what exceeds two standard
  deviations counts against it.

The sum gives a p-value.  A token is reported if its p-value is within the Benjamini-Hochberg bound for a false
discovery rate of ``RATE`` among all tokens of about its length: p-values are counted in fixed bins per length
class over the whole table, so the bound needs a few hundred numbers however many tokens there are.  Length thus
counts twice: short tokens cannot get a small p-value, and they are judged among their like.

All of it is done by Spark's own expressions.  Defined cases: null and empty texts have no spans; matches of one
kind do not overlap, those of different kinds may; equal starts are ordered by kind as listed; repeated rows give
repeated results (and count repeatedly among the tokens); an empty table gives an empty result; columns that are
added replace those of the same name, further ones are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import query, table, without
from tidewatch.session import stage

KINDS = ("assign", "access", "hex", "random")
NAMES = ("password", "passwd", "secret", "token", "api")
# fixed values: the base patterns; runs of one alphabet need no check of a shorter match
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGNED = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
SHORTEST = 20
TOKEN = "[A-Za-z0-9+/_=-]{%d,}" % SHORTEST
TEXT_SKEW = {16: 1.6, 32: 1.6, 64: 3.2}
TEXT_TURNS = 0.12
RATE = 0.01
BINS, STEP = 400, 0.1       # of -log10 p
CLASSES = (32, 48, 80, 160)


def _spans(text: Column, pattern: str, valid: Column | None, kind: int, look: Column) -> Column:
    """Spans (start, kind, end) of the matches of a pattern, where ``look`` holds."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.transform(found, lambda x: F.char_length(x))
    good = valid if valid is not None else F.transform(found, lambda x: F.lit(True))
    steps = F.arrays_zip(gaps.alias("gap"), lengths.alias("length"), good.alias("good"))
    begin = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<struct<start:int,kind:int,end:int>>").alias("spans"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + x["length"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.when(x["length"].isNull(), a).otherwise(F.struct(
            end.alias("at"), F.when(x["good"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans")))

    none = F.expr("array()").cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(look, F.aggregate(steps, begin, step, lambda a: a["spans"])).otherwise(none)


def _base(text: Column) -> list[Column]:
    low = F.lower(text)
    named = low.contains(NAMES[0])
    for name in NAMES[1:]:
        named = named | low.contains(name)
    assigned = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)), lambda x: F.char_length(x) >= ASSIGNED)
    return [_spans(text, ASSIGN, assigned, 0, named & text.rlike(ASSIGN)),
            _spans(text, ACCESS, None, 1, text.contains("AKIA")),
            _spans(text, HEX, None, 2, text.rlike(HEX))]


def _phi(z: Column) -> Column:
    """Upper tail of the normal distribution, to about 1e-7 of its size (Zelen and Severo)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * t * (
        0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def randomness(token: Column) -> Column:
    """p-value of the hypothesis that a token is ordinary text."""
    size = F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(token.rlike("^[A-Z2-7]+=*$"), 32).otherwise(64)
    codes = F.transform(F.regexp_extract_all(token, F.lit("."), F.lit(0)), lambda c: F.ascii(c))

    def chi_step(a, x):
        run = F.when(x == a["last"], a["run"]).otherwise(F.lit(0).cast("long"))
        return F.struct(x.alias("last"), (run + 1).alias("run"), (a["sum"] + 2 * run + 1).alias("sum"))

    def kind(x):
        return F.when(x.between(48, 57), 0).when(x.between(97, 122), 1).when(x.between(65, 90), 2).otherwise(3)

    def walk(a, x):
        return F.struct(
            x.alias("last"), (a["turns"] + F.when((a["last"] >= 0) & (kind(a["last"]) != kind(x)), 1).otherwise(0)).alias("turns"),
            (a["x"] + x).alias("x"), (a["xx"] + x * x).alias("xx"),
            (a["xy"] + F.when(a["last"] >= 0, a["last"] * x).otherwise(0)).alias("xy"))

    zero = F.lit(0).cast("long")
    squares = F.aggregate(F.array_sort(codes), F.struct(F.lit(-1).alias("last"), zero.alias("run"), zero.alias("sum")),
                          chi_step, lambda a: a["sum"])
    walked = F.aggregate(codes, F.struct(F.lit(-1).alias("last"), zero.alias("turns"), zero.alias("x"), zero.alias("xx"),
                                         zero.alias("xy")), walk)
    n = F.char_length(token).cast("double")
    skew = F.when(size == 16, TEXT_SKEW[16]).when(size == 32, TEXT_SKEW[32]).otherwise(TEXT_SKEW[64])
    uniform = (size - 1 + n * skew - (size * squares / n - n)) / F.sqrt(2 * (size - 1) + 4 * n * skew)
    turns = (walked["turns"] - (n - 1) * TEXT_TURNS) / F.sqrt((n - 1) * TEXT_TURNS * (1 - TEXT_TURNS))
    mean = walked["x"] / n
    spread = walked["xx"] / n - mean * mean
    lag = F.when(spread > 0, (walked["xy"] / (n - 1) - mean * mean) / spread).otherwise(1.0)
    against = F.greatest(F.lit(0.0), F.abs(lag) * F.sqrt(n) - 2)
    return _phi((uniform + turns) / F.sqrt(F.lit(2.0)) - against)


def _class(n: Column) -> Column:
    out = F.lit(0)
    for i, edge in enumerate(CLASSES):
        out = F.when(n >= edge, i + 1).otherwise(out)
    return out


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) / STEP)).cast("int")


def bounds(tokens: DataFrame) -> dict[int, int]:
    """Per length class, the lowest bin of -log10 p that is within the false discovery rate; from counts in at
    most ``BINS`` bins of a handful of classes."""
    counts = tokens.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for c in {r["class"] for r in counts}:
        mine = {r["bin"]: r["n"] for r in counts if r["class"] == c}
        total, so_far = sum(mine.values()), 0
        for b in sorted(mine, reverse=True):
            so_far += mine[b]
            if total * 10 ** (-b * STEP) <= RATE * so_far:
                out[c] = b
    return out


def _found(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(_row, _base, _spans): the columns ``keep`` of each row, packed, its base spans and all spans."""
    packed = F.struct(F.lit(0).alias("_"), *[docs[c].alias(c) for c in keep])
    source = docs.select(packed.alias("_row"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("_text"))
    whole = F.col("_text")
    based = source.withColumn("_base", F.array_sort(F.concat(*_base(whole))))
    tokens = _spans(whole, TOKEN, None, 3, whole.rlike(TOKEN))
    free = F.filter(tokens, lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    tried = based.withColumn("_tokens", F.transform(free, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), _class(t["end"] - t["start"]).alias("class"),
        _bin(randomness(F.substring(whole, t["start"] + 1, t["end"] - t["start"]))).alias("bin"))))
    written = stage(tried.drop("_text"), "tokens")
    least = bounds(written.select(F.explode("_tokens").alias("t")).select("t.class", "t.bin"))

    def reported(t):
        out = F.lit(False)
        for c, b in least.items():
            out = out | ((t["class"] == c) & (t["bin"] >= b))
        return out

    added = F.transform(F.filter("_tokens", reported), lambda t: F.struct(
        t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return written.select("_row", "_base", F.array_sort(F.concat("_base", added)).alias("_spans"))


def secret_spans(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` (without its text, unless it is kept) with ``base`` and ``spans``: arrays of (start, kind, end) in
    code points, in order; ``kind`` is a place in ``KINDS``."""
    keep = without(docs, "base", "spans", *([] if keep_text else [text])).columns
    return _found(docs, text, keep).select(*[F.col("_row")[c].alias(c) for c in keep], F.col("_base").alias("base"),
                                           F.col("_spans").alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", by: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``by``; spans that meet are replaced together."""
    keep = docs.columns
    merged = F.aggregate("_spans", F.expr("array()").cast("array<struct<start:int,end:int>>"), lambda a, s: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["start"]),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
            F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"))))
    ).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    cut = _found(docs, text, keep).select("_row", F.when(F.size("_spans") > 0, merged).alias("_cut"))
    whole = F.col("_row")[text]

    def end_of(i):
        return F.when(i > 0, F.get("_cut", i - 1)["end"]).otherwise(0)

    pieces = F.transform(F.sequence(F.lit(0), F.size("_cut")), lambda i: F.substring(
        whole, end_of(i) + 1, F.coalesce(F.get("_cut", i)["start"], F.char_length(whole)) - end_of(i)))
    new = F.when(F.col("_cut").isNull(), whole).otherwise(F.array_join(pieces, by))
    return cut.select(*[(new if c == text else F.col("_row")[c]).alias(c) for c in keep])


@query("op7_secrets")
def op7_secrets(spark, folder):
    """Secrets in every whole text of `documents`."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = secret_spans(docs, keep_text=False)

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
