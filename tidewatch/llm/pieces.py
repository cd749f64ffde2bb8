"""SentencePiece encoding and decoding by a table of distinct marked words.

Where no piece of a model crosses a whitespace marker (a marker never follows another character inside a
piece), merges on one side of such a border cannot touch the other side.  A text is then a sequence of
marked words, a run of markers and what follows up to the next marker, and its segmentation is that of its
words.  Each task keeps a table of the distinct marked words it has met, segments a new one once with the
library, and joins the ids back by position.  The table is emptied when it is full, so memory is bounded by
``TABLE_ROWS`` however many words the corpus has; nothing is shuffled and any lost task is simply run again.

Defined cases: null and empty texts have no ids and decode to the empty text; a text of blanks or without
any blank is a single (long) marked word; a literal marker character counts as a blank, as in the library;
rows are independent, so repeated rows give repeated results; an empty table gives an empty result; columns
whose names clash with those added are replaced, all others are kept.  Models with other whitespace rules
(normalisers, suffix markers, crossing pieces) are segmented text by text.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tidewatch.llm.base import extended, query, table, without

MARK = "▁"
TABLE_ROWS = 150_000
KINDS = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded": "string",
         "decoded_sha256": "string"}


def splits_at_markers(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether a text may be segmented word by word under this model."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model.serialized_model_proto())
    rules = proto.normalizer_spec
    pieces = [p.piece for p in proto.pieces]
    return (not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces
            and rules.escape_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
            and proto.trainer_spec.model_type == proto.trainer_spec.BPE and MARK in pieces
            and not any(p.type == p.USER_DEFINED for p in proto.pieces)
            and not any(MARK in p.lstrip(MARK) for p in pieces))


class Words:
    """Table of distinct marked words: the ids of each, and those ids as text."""

    def __init__(self, path: str, rows: int = TABLE_ROWS):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_word = splits_at_markers(self.model)
        self.rows = rows
        self.clear()

    def clear(self) -> None:
        blank = [self.model.piece_to_id(MARK)]
        self.ids = {"": blank}
        self.digits = {"": str(blank[0])}

    def words(self, text: str) -> list[str]:
        """Marked words of a text, each without its first marker (the library puts one in front itself)."""
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [w[1:] for w in re.findall(" +[^ ]*", " " + text.replace(MARK, " "))]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[str]]:
        """Ids of every text, and the ids in decimal joined by commas."""
        if not self.by_word:
            ids = self.model.encode(texts, num_threads=1)
            return ids, [",".join(map(str, x)) for x in ids]
        split = [self.words(t) if t else [] for t in texts]
        if len(self.ids) > self.rows:
            self.clear()
        new = list({w for words in split for w in words if w not in self.ids})
        for word, ids in zip(new, self.model.encode(new, num_threads=1)):
            self.ids[word] = ids
            self.digits[word] = ",".join(map(str, ids))
        look, say = self.ids.__getitem__, self.digits.__getitem__
        return ([list(chain.from_iterable(map(look, words))) for words in split],
                [",".join(map(say, words)) for words in split])


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    """One table per worker process, kept between the tasks it runs."""
    return Words(path)


def _slices(column: pa.Array, most: int = 1 << 20):
    """Texts of a column in lists of about ``most`` characters, so that one list's ids stay small."""
    out, size = [], 0
    for text in column:
        text = text.as_py() or ""
        out.append(text)
        size += len(text)
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def encode_pieces(df: DataFrame, path: str, text: str = "text", add: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """``df`` with the columns named in ``add``: the ids of a text, their number, the text they decode to,
    and digests of both (of the decimal ids joined by commas, and of the decoded text in UTF-8)."""
    kept = without(df, *add)
    schema = extended(kept.schema, **{c: KINDS[c] for c in add})
    # the text column may itself be replaced by one that is added
    source = df.select(df[text].alias("__tw_text"), *[kept[c] for c in kept.columns])

    def run(batches):
        made = words_of(path)
        for batch in batches:
            got: dict[str, list] = {c: [] for c in add}
            for texts in _slices(batch.column(0)):
                ids, digits = made.encode(texts)
                back = made.model.decode(ids, num_threads=1) if {"decoded", "decoded_sha256"} & got.keys() else []
                for c in add:
                    if c == "ids":
                        got[c] += ids
                    elif c == "n_tokens":
                        got[c] += map(len, ids)
                    elif c == "ids_sha256":
                        got[c] += [hashlib.sha256(d.encode()).hexdigest() for d in digits]
                    elif c == "decoded":
                        got[c] += back
                    else:
                        got[c] += [hashlib.sha256(d.encode()).hexdigest() for d in back]
            kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
            new = [pa.array(got[c], kinds.get(c, pa.string())) for c in add]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names=schema.names)

    return source.mapInArrow(run, schema)


def decode_pieces(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids of each row stand for; null ids stand for the empty text."""
    kept = without(df, to)
    schema = extended(kept.schema, **{to: "string"})
    source = df.select(df[ids].alias("__tw_ids"), *[kept[c] for c in kept.columns])

    def run(batches):
        model = words_of(path).model
        for batch in batches:
            back = [model.decode([i for i in x if i is not None]) if x else "" for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(back, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


@query("op6_sentencepiece")
def op6_sentencepiece(spark, folder):
    """Every whole text of `documents` in pieces and back again."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    coded = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"),
                          add=("n_tokens", "ids_sha256", "decoded_sha256"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
