import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm.alignment import ADDED, Alignments, align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain(texts):
    a_model = Tokenizer.from_file(A)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=B)
    of = letters()
    docs = []
    for text in texts:
        a, b = [], []
        if text:
            a = [(i, bytes(of[c] for c in a_model.id_to_token(i)))
                 for i in a_model.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode())
                 for i in b_model.encode(text) for p in [b_model.id_to_piece(i)]]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                a, b = [], []
        docs.append((spread(a), spread(b)))
    counts = Counter()
    linked = []
    for a, b in docs:
        links, k = [], 0
        for i, x, y in a:
            while k < len(b) and b[k][2] <= x:
                k += 1
            j = k
            while j < len(b) and b[j][1] < y:
                links.append((i, b[j][0]))
                j += 1
        linked.append(links)
        counts.update(set(links))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(n, best.get(i, 0))
    out = []
    for (a, b), links in zip(docs, linked):
        ends = sorted({y for _, _, y in a} & {y for _, _, y in b})
        said = [",".join(str(i) for i, _, y in a if s < y <= e) + "|" + ",".join(str(i) for i, _, y in b if s < y <= e)
                for s, e in zip([0] + ends, ends)]
        out.append((len(a), len(b), len(ends), len(links), sum(counts[x] == best[x[0]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(";".join(said).encode()).hexdigest() if a else ""))
    return out


def spread(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def strange(n, seed=1):
    draw = random.Random(seed)
    bits = ["a", "b ", "  ", " ", "\n", "\n\n", "the", "é", "😀", "\t", " x", "　", "ﬁ", "\x00", "<0x41>", "<|endoftext|>",
            "<s>", "'s", " 12", "\x1c", "\xa0", "\x85", "\r\n", "Tion ing", ".,", " \n ", "hello world", "日本"]
    return ["".join(draw.choice(bits) for _ in range(draw.randint(0, 12))) for _ in range(n)]


def check(spark, texts, **limits):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn(
        "N_A", F.lit(1)).withColumn("pair", F.lit("clash")).withColumn("a", F.lit(2))
    got = align(docs, A, B, **limits)
    assert got.columns == ["doc_id", "text", "pair", "a", *ADDED]
    assert [tuple(r[c] for c in ADDED) for r in got.orderBy("doc_id").collect()] == plain(texts)


def test_units_are_aligned_like_whole_texts():
    made = Alignments(A, B, limit=1 << 16)
    assert made.vocabularies.by_unit
    whole = Alignments(A, B)
    whole.vocabularies.by_unit = False
    texts = strange(3000) + ["x▁y", "▁", " ", "\n", "word " * 3000, "x" * 3000, " a\nb", "\n b"]
    for at in range(0, len(texts), 200):
        one, two = made.documents(texts[at:at + 200]), whole.documents(texts[at:at + 200])
        assert (one[0] == two[0]).all() and one[1] == two[1]
        assert all((x == y).all() for k in (2, 3) for x, y in zip(one[k], two[k]))


def test_equals_plain_version(spark, folder):
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(60).collect()]
    texts += strange(150, 2) + [None, "", "x▁y", texts[0], texts[0], "a" * 2000, " ", "\n"]
    check(spark, texts)
    check(spark, texts, most_pairs=10)          # counts are joined instead of sent to all workers


def test_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    check(spark, [None, "", "▁"])
