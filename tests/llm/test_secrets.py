import hashlib
import math
import random
import re
import string
from collections import Counter

from pyspark.sql import functions as F

from tidewatch.llm import secrets
from tidewatch.llm.secrets import KINDS, redact, secret_spans

ASSIGN = re.compile("((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def p_value(token):
    size = 16 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token) else 32 if re.fullmatch("[A-Z2-7]+=*", token) else 64
    n, skew = len(token), secrets.TEXT_SKEW[size]
    chi = size / n * sum(c * c for c in Counter(token).values()) - n
    uniform = (size - 1 + n * skew - chi) / math.sqrt(2 * (size - 1) + 4 * n * skew)
    kind = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in token]
    q = secrets.TEXT_TURNS
    turns = (sum(a != b for a, b in zip(kind, kind[1:])) - (n - 1) * q) / math.sqrt((n - 1) * q * (1 - q))
    x = [ord(c) for c in token]
    mean = sum(x) / n
    spread = sum(v * v for v in x) / n - mean * mean
    lag = (sum(a * b for a, b in zip(x, x[1:])) / (n - 1) - mean * mean) / spread if spread > 0 else 1.0
    z = (uniform + turns) / math.sqrt(2) - max(0.0, abs(lag) * math.sqrt(n) - 2)
    return 0.5 * math.erfc(z / math.sqrt(2))


def brute(texts):
    """Base and all spans of each text."""
    found, tokens = [], []
    for i, text in enumerate(texts):
        mine = base(text)
        found.append(mine)
        for m in re.finditer("[A-Za-z0-9+/_=-]{%d,}" % secrets.SHORTEST, text or ""):
            if not any(a < m.end() and m.start() < b for a, _, b in mine):
                p = max(p_value(m[0]), 1e-300)
                tokens.append((i, m.start(), m.end(), sum(len(m[0]) >= c for c in secrets.CLASSES),
                               min(secrets.BINS, math.floor(-math.log10(p) / secrets.STEP))))
    least = {}
    for c in {t[3] for t in tokens}:
        bins = [t[4] for t in tokens if t[3] == c]
        good = [b for b in bins if len(bins) * 10 ** (-b * secrets.STEP) <= secrets.RATE * sum(x >= b for x in bins)]
        if good:
            least[c] = min(good)
    every = [list(f) for f in found]
    for i, a, b, c, at in tokens:
        if c in least and at >= least[c]:
            every[i].append((a, 3, b))
    return found, [sorted(e) for e in every]


def planted():
    draw = random.Random(9)
    words = ["".join(draw.choices("etaoinshrdlu", k=draw.randint(2, 9))) for _ in range(200)]
    base64 = string.ascii_letters + string.digits + "+/"
    texts = []
    for i in range(150):
        parts = draw.choices(words, k=draw.randint(0, 30))
        for _ in range(draw.randint(0, 3)):
            parts.insert(draw.randint(0, len(parts)), draw.choice([
                lambda: "Password: " + "".join(draw.choices(base64, k=draw.randint(1, 12))),
                lambda: "api_key='" + "".join(draw.choices(base64, k=20)) + "'",
                lambda: "token=secret:abcdefgh", lambda: "TOKEN = token=x", lambda: "AKIA" + "A1" * draw.randint(4, 12),
                lambda: "".join(draw.choices("0123456789abcdef", k=draw.randint(20, 70))),
                lambda: "".join(draw.choices(base64, k=draw.randint(18, 90))),
                lambda: "é😀" + "".join(draw.choices("0123456789ABCDEF", k=64)),
                lambda: "a" * draw.randint(15, 50), lambda: "".join(draw.choices(words, k=6)),
                lambda: "Key paſsword=abcdefgh", lambda: "abcdefghijklmnopqrstuvwxyz0123456789"])())
        texts.append(" ".join(parts))
    return texts + ["", None, "secret=" + "x" * 5000, "deadbeef" * 2000, texts[0], texts[0]]


def test_equals_brute_force(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn(
        "Spans", F.lit("x")).withColumn("_text", F.lit(1)).withColumn("class", F.lit(2))
    got = {r.doc_id: r for r in secret_spans(docs).collect()}
    mine, every = brute(texts)
    assert sum(k == 3 for e in every for _, k, _ in e) > 10
    for i in range(len(texts)):
        assert [tuple(s) for s in got[i].base] == mine[i]
        assert [tuple(s) for s in got[i].spans] == every[i]
        assert got[i]._text == 1 and got[i]["class"] == 2 and got[i].text == texts[i]


def test_query_digests(spark, tmp_path):
    texts = planted()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    mine, every = brute(texts)
    for r in secrets.op7_secrets(spark, str(tmp_path)).collect():
        said = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in x[r.doc_id]) for x in (mine, every)]
        assert r.base_sha256 == hashlib.sha256(said[0].encode()).hexdigest() and r.spans == said[1]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in mine[r.doc_id]) for j in range(3)]


def test_redaction(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_cut", F.lit("c"))
    _, every = brute(texts)
    for r in redact(docs).collect():
        left, at = "", 0
        runs = []
        for a, _, b in every[r.doc_id]:
            if runs and runs[-1][1] >= a:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        for a, b in runs:
            left, at = left + texts[r.doc_id][at:a] + "[SECRET]", b
        assert r._cut == "c"
        assert r.text == (left + texts[r.doc_id][at:] if runs else texts[r.doc_id])
    assert redact(docs.limit(0)).count() == 0
