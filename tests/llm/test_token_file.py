import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm.range_coder import LANES, LEAST_STEPS, decode_block, encode_block
from tidewatch.llm.token_file import Units, read_token_file, unit_starts, write_token_file
from tidewatch.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def strange(n):
    draw = random.Random(3)
    bits = ["a", " b", "  ", " ", "\n", "the", "é", "😀", "\t", " x's", "12", "\r\n", "　", "\x1c", "\x85", "!?", "_",
            "<|endoftext|>"]
    return ["".join(draw.choice(bits) for _ in range(draw.randint(0, 12))) for _ in range(n)]


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 255, 256, 257, 5000, 70000):
        for ids in (rng.integers(0, 50257, n), np.minimum(rng.zipf(1.3, n), 50256), np.tile([5, 6, 50256, 0], n)[:n]):
            assert (decode_block(encode_block(ids, 50257), n, 50257) == ids).all()


def test_repeated_ids_take_few_bytes():
    assert len(encode_block(np.tile([5, 6, 7, 50256], 20000), 50257)) < 8000


def test_units_equal_the_library():
    units, whole = Units(PATH), Tokenizer.from_file(PATH)
    assert units.by_unit
    texts = strange(4000) + ["word " * 20000, "x" * 5000]
    got = [np.frombuffer(x, "<u4").tolist() for x in units.encode(texts)]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_units_are_cut_where_kinds_of_characters_meet():
    text = " one, two.\nThree  4x can't ü,  “q” \n\nend "
    edges = np.append(np.flatnonzero(unit_starts(np.frombuffer(text.encode(), np.uint8))), len(text.encode()))
    assert [text.encode()[a:b].decode() for a, b in zip(edges, edges[1:])] == [
        " one", ",", " two", ".", "\n", "Three ", " 4", "x", " can", "'t", " ü, ", " “q” \n\nend "]
    units = Units(PATH)
    units.encode(["word, word. word! word\n word; word\n" * 50])
    assert sum(b"word" in u for u in units.table) == 2          # with a blank and, at the start, without


def test_units_of_one_kind_after_another():
    draw, bits = random.Random(5), [*" ,.'xZé9\n\r\x0b(²\u0301\u2003\u2028\xa0\x85\x1c\x00あ“"] + ["'s", "'ll", " ", "  ", "<|endoftext|>"]
    texts = ["".join(draw.choices(bits, k=draw.randint(0, 9))) for _ in range(20000)]
    units, whole = Units(PATH), Tokenizer.from_file(PATH)
    got = [np.frombuffer(x, "<u4").tolist() for at in range(0, len(texts), 7) for x in units.encode(texts[at:at + 7])]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_wide_block_round_trip():
    ids = np.minimum(np.random.default_rng(2).zipf(1.2, LANES * LEAST_STEPS + 5), 50256)
    assert LANES == 8192 and (decode_block(encode_block(ids, 50257), len(ids), 50257) == ids).all()


def test_file_round_trip(spark, folder):
    whole = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (None, "no id"), (7, "again"), (7, "again"), (10**12, "")] +
                              [(1000 + i, t) for i, t in enumerate(strange(60))], "doc_id long, text string"))
    path = scratch_path(spark, "tokens")
    write_token_file(docs.withColumn("START", F.lit(1)), path, PATH, block=20000)
    got = read_token_file(spark, path).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    assert len(got) == len(rows)
    for g, r in zip(got, rows):
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert (g.doc_id, g.start, g.n_tokens, g.ids) == (r.doc_id, start, len(ids), ids)
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_damage_is_noticed(spark):
    path = scratch_path(spark, "tokens")
    write_token_file(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), path, PATH)
    again = scratch_path(spark, "tokens")
    spark.read.parquet(path).withColumn("crc32", F.col("crc32") + 1).write.parquet(again)
    with pytest.raises(Exception, match="damaged"):
        read_token_file(spark, again).collect()


def test_empty_table(spark):
    path = scratch_path(spark, "tokens")
    write_token_file(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert read_token_file(spark, path).count() == 0
