"""Token ids of documents as a range-coded binary file.

Documents are range-partitioned and sorted by id, encoded, and written as a table of blocks: each row is one
block of whole documents with its ids coded by ``range_coder`` (which starts anew in every block), the number of
ids, their CRC-32, and the ids and lengths of its documents.  Parquet is only the container: it gives atomic
commits, so a lost executor costs a task, and any store that Spark writes to.  A reader decodes any block by
itself, checks its checksum and places it by the sums of the parts before it, a row per partition.

The vocabulary's byte-level pre-tokenizer always starts a chunk at a blank before a non-blank character and where
letters, digits, marks and white space meet, so a text is encoded unit by unit between such places: every task keeps a bounded table of the units it has met and
calls the tokenizers library for new ones only, many of them as one text, as only a unit's first id starts with a
blank.  Units are cut, told apart and replaced by their ids as arrays.  Texts that hold one of the tokenizer's
added tokens, and other tokenizers, encode whole texts.

Defined cases: null and empty texts have the end id only; rows are ordered by id (rows without one first), then
by text, so repeated rows are next to each other and each is written; a block holds at least one document
however long; an empty table gives an empty file; further columns are not written.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.base import query, table
from tidewatch.llm.range_coder import checksum, decode_block, encode_block
from tidewatch.session import scratch_path

BLOCK = 1 << 22             # ids after which a block is closed
TABLE_ROWS = 400_000        # units remembered per worker
TOGETHER = 2_000            # new units given to the library as one text
TEXT = 1 << 22              # characters of texts encoded at once
END = 0
BLOCKS = ("part int, block int, first long, n long, vocabulary int, crc32 long, payload binary, "
          "doc_ids array<long>, lengths array<long>")


_LETTER, _DIGIT, _MARK, _SPACE = 1, 2, 3, 4     # kinds of ASCII characters; blanks, controls and others are 0
_KIND = np.array([_LETTER if chr(i).isalpha() else _DIGIT if chr(i).isdigit() else _MARK if 32 < i < 127 else
                  _SPACE if 9 <= i <= 13 else 0 for i in range(128)] + [0] * 128, np.uint8)


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Whether a unit may start at each of the bytes of UTF-8 text, as the pre-tokenizer surely starts a chunk there:
    at a blank before another character than white space, between ASCII letters, digits, marks and white space, but
    not behind an apostrophe, which may belong to the next letters, nor behind a run of white space, as the last
    of the run is a chunk by itself."""
    kind = _KIND[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (data[:-1] != 39)
    cut[2:] &= (kind[1:-1] != _SPACE) | ((kind[:-2] > 0) & (kind[:-2] != _SPACE))
    cut[1:2] &= kind[:1] != _SPACE
    at = np.flatnonzero(data[:-1] == 32)
    after = data[at + 1]
    rare = np.flatnonzero(np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3)))         # may be the first byte of a white space
    sure = after > 32
    padded = np.append(data, np.zeros(3, np.uint8))
    a, b, c = (padded[at[rare] + i] for i in (1, 2, 3))
    sure[rare] = ~(((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) |
                   ((a == 0xE2) & ((b == 0x80) | (b == 0x81)) & ((c <= 0x8A) | (c >= 0x9F))) | ((a == 0xE3) & (b == 0x80)))
    cut[at[sure]] = True
    return cut


class Units:
    """Ids of texts, from a table of distinct units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"          # Spark already runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        before = rules["pre_tokenizer"] or {}
        self.by_unit = (rules["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and
                        before.get("use_regex", True) and not before.get("add_prefix_space") and
                        not rules["normalizer"] and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or
                                                            t["single_word"] for t in rules["added_tokens"]))
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.added = [t["content"].encode() for t in rules["added_tokens"]]
        names = self.tokenizer.get_vocab()
        self.opens = np.zeros(1 + max(names.values(), default=0), bool)         # ids whose first byte is a blank
        self.opens[[i for name, i in names.items() if name.startswith("Ġ")]] = True
        self._clear()

    def _clear(self) -> None:
        self.table: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, "<u4")                     # of all units of the table, one after the other
        self.ends = np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), 10_000):
            out += [np.array(e.ids, "<u4")
                    for e in self.tokenizer.encode_batch_fast(texts[at:at + 10_000], add_special_tokens=False)]
        return out

    def _add(self, units: list[bytes]) -> None:
        """Put new units into the table."""
        alone = [u for u in units if u[:1] != b" " or u.find(b" ", 1) > 0]
        single = set(alone)
        plain = [u for u in units if u not in single] if single else units
        groups = [plain[at:at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        parts, sizes, names = [], [], []
        for group, ids in zip(groups, self._ids([b"".join(g).decode() for g in groups])):
            first = np.flatnonzero(self.opens[ids])
            if len(first) != len(group):
                alone += group
                continue
            parts.append(ids)
            sizes.append(np.diff(first, append=len(ids)))
            names += group
        each = self._ids([u.decode() for u in alone])
        sizes.append(np.array([len(x) for x in each], np.int64))
        new = np.concatenate([*parts, *each]) if parts or each else np.zeros(0, "<u4")
        have = int(self.ends[-1])
        if have + len(new) > len(self.ids):
            self.ids = np.append(self.ids[:have], np.zeros(have + 2 * len(new), "<u4"))
        self.ids[have:have + len(new)] = new
        self.table.update(zip(names + alone, range(len(self.table), len(self.table) + len(units))))
        self.ends = np.append(self.ends, have + np.cumsum(np.concatenate(sizes)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four bytes each."""
        if not self.by_unit:
            return [x.tobytes() for x in self._ids(texts)]
        raw = [t.encode() for t in texts]
        whole = [i for i, r in enumerate(raw) if any(a in r for a in self.added)]
        if whole:
            apart = dict(zip(whole, self._ids([texts[i] for i in whole])))
            raw = [b"" if i in apart else r for i, r in enumerate(raw)]
        joined = b"".join(raw)
        if not joined:
            return [apart[i].tobytes() if whole and i in apart else b"" for i in range(len(raw))]
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        begins = np.append(0, ends)
        edge = np.append(unit_starts(data), True)
        edge[ends[ends > 0] - 1] &= data[ends[ends > 0] - 1] != 32      # a blank that ends its text has nothing behind it
        edge[begins] = True
        edges = np.flatnonzero(edge)                            # of the units, and the end of the last one
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [
            None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(joined)]).dictionary_encode()
        names = units.dictionary.to_pylist()
        if len(self.table) > TABLE_ROWS:
            self._clear()
        self._add([n for n in names if n not in self.table])
        number = np.fromiter(map(self.table.__getitem__, names), np.int64, len(names))[units.indices.to_numpy()]
        first, sizes = self.ends[number], self.ends[number + 1] - self.ends[number]
        before = np.append(0, np.cumsum(sizes))
        ids = self.ids[np.repeat(first - before[:-1], sizes) + np.arange(before[-1])]
        at = before[np.searchsorted(edges, begins)]
        return [apart[i].tobytes() if whole and i in apart else ids[a:b].tobytes()
                for i, (a, b) in enumerate(zip(at[:-1], at[1:]))]


@lru_cache(maxsize=2)
def units_of(path: str) -> Units:
    return Units(path)


def _texts(batch: pa.RecordBatch, most: int = TEXT):
    """(ids, texts) of some rows at a time, so that little is held."""
    ids, texts, size = [], [], 0
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        ids.append(i)
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end: int = END, block: int = BLOCK) -> None:
    """Write the ids of ``docs`` (doc_id, text) in ascending order of id, each document closed by ``end``."""
    def run(batches):
        units, part = units_of(tokenizer), TaskContext.get().partitionId()
        first, count = 0, 0
        names: list = []
        held: list[np.ndarray] = []

        def flush():
            nonlocal first, count, names, held
            ids = np.concatenate(held)
            row = [part, number, first, len(ids), units.vocabulary, checksum(ids),
                   encode_block(ids, units.vocabulary), names, [len(x) for x in held]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(),
                     pa.list_(pa.int64()), pa.list_(pa.int64())]
            first, count, names, held = first + len(ids), 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)],
                                              names=[c.split()[0] for c in BLOCKS.split(", ")])

        number = 0
        for batch in batches:
            for ids, texts in _texts(batch):
                for name, coded in zip(ids, units.encode(texts)):
                    held.append(np.append(np.frombuffer(coded, "<u4"), np.uint32(end)))
                    names.append(name)
                    count += len(held[-1])
                    if count >= block:
                        yield flush()
                        number += 1
        if names:
            yield flush()

    placed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(
        F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    placed.mapInArrow(run, BLOCKS).write.mode("error").parquet(path)


def _offsets(blocks: DataFrame) -> DataFrame:
    """(part, ids of all parts before it): a row per partition that wrote the file."""
    sums = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    return sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def read_token_file(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of the documents in a file; ``start`` counts all ids before."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                made = decode_block(row["payload"], row["n"], row["vocabulary"]).astype("<u4")
                if checksum(made) != row["crc32"]:
                    raise ValueError(f"block {row['block']} of part {row['part']} is damaged")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                parts = [made[a:b] for a, b in zip(ends - lengths, ends)]
                columns = [pa.array(row["doc_ids"], pa.int64()),
                           pa.array(ends - lengths + row["first"] + row["before"], pa.int64()),
                           pa.array(lengths, pa.int64()),
                           pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                if ids:
                    columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    placed = blocks.join(_offsets(blocks), "part")
    return placed.mapInArrow(run, schema)


@query("op1_token_file")
def op1_token_file(spark, folder):
    """Whole `documents` as token ids, written to a file and read back from it."""
    path = scratch_path(spark, "tokens")
    write_token_file(table(spark, folder, "documents", "doc_id", "text"), path,
                     public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_file(spark, path, ids=False)
