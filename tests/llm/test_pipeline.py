import random
import re

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tidewatch.session import stage

from test_decontaminate import brute as leaked
from test_near_copies import brute as copies
from test_secrets import brute as secret


def test_stages_equal_plain_versions(spark, tmp_path, folder):
    draw = random.Random(12)
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    noise = " ".join("".join(draw.choices("жщцзфхюя", k=7)) for _ in range(200))
    docs += [(5000, noise, None, "s", 1), (5001, None, "en", "s", 0), (5002, "12 34 !!", None, None, None),
             (5003, docs[0][1] + " key AKIA" + "Z9" * 9, "en", "s", 5), (5004, docs[1][1], "en", "s", 5),
             (5005, docs[2][1] + " password: hunter2hunter2 and more", "en", "s", 5)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontamination", "secrets", "pieces"]

    now = stage(steps["language"](spark, now, str(tmp_path)), "t")
    assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id: r for r in now.collect()}
    assert set(kept) == {d[0] for d in docs} - {5000, 5001, 5002}
    known = {d[0]: d[2] for d in docs}
    assert sum(kept[i].lang != known[i] for i in kept) <= 0.02 * len(kept)

    now = stage(steps["near_copies"](spark, now, str(tmp_path)), "t")
    left = {i for i, _, component, stays in copies([(i, r.text) for i, r in sorted(kept.items())], 80) if stays}
    assert sorted(r.doc_id for r in now.collect()) == sorted(left) and len(left) < len(kept)

    now = stage(steps["decontamination"](spark, now, str(tmp_path)), "t")
    left -= {r[0] for r in leaked([(i, kept[i].text) for i in sorted(left)], items)}
    assert sorted(r.doc_id for r in now.collect()) == sorted(left)

    now = stage(steps["secrets"](spark, now, str(tmp_path)), "t")
    order = sorted(left)
    _, every = secret([kept[i].text for i in order])
    expected = {}
    for i, spans in zip(order, every):
        gone = [False] * (len(kept[i].text) + 1)
        for a, _, b in spans:
            gone[a:b] = [True] * (b - a)
        text = "".join("\0" if g else c for c, g in zip(kept[i].text, gone))
        expected[i] = re.sub("\0+", "[SECRET]", text)
    got = {r.doc_id: r for r in now.collect()}
    assert {i: r.text for i, r in got.items()} == expected
    assert all(r.n_chars == len(r.text) for r in got.values()) and now.columns[:2] == ["doc_id", "text"]

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.ids for r in last} == {i: model.encode(t) for i, t in expected.items()}
    assert len(last) == len(expected) and all(r.n_tokens == len(r.ids) for r in last)


def test_empty_table(spark, tmp_path, folder):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
