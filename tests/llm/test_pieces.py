import hashlib
import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from tidewatch.llm.pieces import Words, decode_pieces, encode_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def strange(n):
    draw = random.Random(1)
    bits = ["a", "b ", "  ", " ", "▁", "\n", "the", "é", "😀", "\t", " x", "x▁▁", "　", "ﬁ", "\x00"]
    return ["".join(draw.choice(bits) for _ in range(draw.randint(0, 14))) for _ in range(n)]


def test_ids_equal_the_library():
    made, model = Words(PATH, rows=50), sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert made.by_word
    texts = strange(5000) + ["word " * 30000, "x" * 20000]
    for at in range(0, len(texts), 500):
        assert made.encode(texts[at:at + 500])[0] == model.encode(texts[at:at + 500])


def test_digests_and_round_trip(spark, folder):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame(
        [(-1, None), (-2, ""), (-2, "")] + [(-3 - i, t) for i, t in enumerate(strange(200))],
        "doc_id long, text string")).withColumn("IDS", F.lit(7)).withColumn("extra", F.lit("e"))
    got = encode_pieces(docs, PATH, add=("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"))
    for r in decode_pieces(got, PATH, to="again").collect():
        ids = model.encode(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.extra == "e"
        assert r.decoded == r.again == model.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_empty_table(spark):
    assert encode_pieces(spark.createDataFrame([], "text string"), PATH).count() == 0
