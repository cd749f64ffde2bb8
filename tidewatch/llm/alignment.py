"""How the tokens of two vocabularies lie over each other: byte-level BPE (A) against SentencePiece (B).

Both encode `` `` + text; where tokens of both end at one byte, the text is cut into groups, and a token of A is
linked with each of B that it shares a byte with.  Counted is in how many documents a pair of ids is linked.

* *Identity map*: for each id of A the id of B with the same bytes, made once.  Pairs of the map, which is what
  one-to-one groups consist of, are counted in a vector as long as the vocabulary and looked up there again.
* Only pairs off the map, from irregular groups, are counted by a shuffle, after the counts of a task's documents
  have been added up.
* Neither tokenizer joins anything over a lone blank between two words, and neither over the border before a line
  break.  So texts are aligned unit by unit between such places; a worker keeps the alignments of the units it has
  met (``TABLE_BYTES``; the table is emptied when full).  Vocabularies for which this does not hold, by their own
  rules, are aligned text by text.

Links of a document are written out once as sorted (pair, times).  The counts of up to ``PAIRS`` pairs off the map
are sent to all workers; if there are more, links are joined with them, which gives the same.

Defined cases: null and empty texts, and those whose tokens do not spell blank + text (such as texts with
U+2581), have no tokens: zeros and an empty digest; every row is a document of its own, so rows that repeat count
each; ties for the most frequent pair count for all; an empty table gives an empty result; further columns are
kept by ``align`` and columns it adds replace those of the same name.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import extended, query, table, without
from tidewatch.session import stage

MARK = "▁"
TABLE_BYTES = 160 << 20         # of remembered alignments per worker, roughly
PAIRS = 4_000_000               # pairs whose counts may be broadcast (16 bytes each)
HELD = 4_000_000                # links whose pairs are counted together in a task
UNIT = re.compile(r"(?<! ) (?=\S)|(?<=\S)(?=\n)")
ADDED = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "n_best": "long", "count_sum": "long",
         "groups_sha256": "string"}


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others
    from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Vocabularies:
    """The two tokenizers, the bytes of their ids and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"          # Spark already runs a worker per core
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        self.size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.bytes_a = [b""] * self.size_a
        for piece, i in self.a.get_vocab().items():
            if all(c in letters for c in piece):
                self.bytes_a[i] = bytes(letters[c] for c in piece)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else
                        p.replace(MARK, " ").encode() for i in range(self.size_b) for p in [self.b.id_to_piece(i)]]
        of = {}
        for i in range(self.size_b):        # a piece goes before a byte of the same value
            if not self.b.is_byte(i) and self.bytes_b[i] or self.bytes_b[i] not in of:
                of[self.bytes_b[i]] = i
        of.pop(b"", None)
        self.same = np.array([of.get(x, -1) for x in self.bytes_a], np.int64)
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        rules = json.loads(self.a.to_str())
        before = rules["pre_tokenizer"] or {}
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.b.serialized_model_proto())
        norm = proto.normalizer_spec
        pieces = [p.piece for p in proto.pieces]
        self.by_unit = (rules["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and
                        before.get("use_regex", True) and not before.get("add_prefix_space") and
                        not rules["normalizer"] and not norm.precompiled_charsmap and norm.add_dummy_prefix and
                        not norm.remove_extra_whitespaces and norm.escape_whitespaces and
                        proto.trainer_spec.model_type == proto.trainer_spec.BPE and MARK in pieces and
                        not proto.trainer_spec.treat_whitespace_as_suffix and
                        not any(p.type == p.USER_DEFINED for p in proto.pieces) and
                        not any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in pieces))

        self.ranked = self._ranked(rules)

    def _ranked(self, rules: dict) -> tiktoken.Encoding | None:
        """The same byte-level vocabulary in the faster library, if its ids follow the order of its merges."""
        ids = rules["model"].get("vocab")
        if not self.by_unit or rules["model"].get("dropout") or rules["model"].get("ignore_merges"):
            return None
        merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in rules["model"]["merges"]]
        if any(x >= y for x, y in zip(merged, merged[1:])) or merged[:1] != [256]:
            return None
        added = {t["id"] for t in rules["added_tokens"]}
        ranks = {x: i for i, x in enumerate(self.bytes_a) if x and i not in added}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for texts that start with a blank, or, as parts of a text, with a line break."""
        if self.ranked:
            a = list(map(self.ranked.encode_ordinary, units))
        else:
            a = [e.ids for at in range(0, len(units), 4096)
                 for e in self.a.encode_batch_fast(units[at:at + 4096], add_special_tokens=False)]
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        # before a line break, the blank that the library puts in front stands alone
        return a, [ids if u[0] == " " else ids[1:] for u, ids in zip(units, b)]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of lists one behind the other, and how many each has."""
    return (np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists)))


def _spelt(flat: np.ndarray, counts: np.ndarray, of: list[bytes], lengths: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Whether the ids of each text spell it."""
    ids = flat.tolist()
    ends = np.cumsum(counts)
    sizes = np.diff(np.concatenate([[0], np.cumsum(lengths[flat])])[np.concatenate([[0], ends])])
    if (sizes == np.fromiter(map(len, texts), np.int64, len(texts))).all() and (
            b"".join(map(of.__getitem__, ids)) == b"".join(texts)):
        return np.ones(len(texts), bool)
    return np.array([b"".join(map(of.__getitem__, ids[e - n:e])) == t
                     for e, n, t in zip(ends.tolist(), counts.tolist(), texts)], bool)


class Lists:
    """Lists of numbers one behind the other, to which more can be added."""

    def __init__(self):
        self.data, self.ends = np.zeros(1 << 12, np.int64), np.zeros(1 << 10, np.int64)
        self.size = self.count = 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        for name, used, new in (("data", self.size, values), ("ends", self.count, self.size + np.cumsum(counts))):
            old = getattr(self, name)
            if used + len(new) > len(old):
                grown = np.zeros(2 * (used + len(new)), np.int64)
                grown[:used] = old[:used]
                setattr(self, name, grown)
            getattr(self, name)[used:used + len(new)] = new
        self.size, self.count = self.size + len(values), self.count + len(counts)

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, number of values) of the lists asked for, one behind the other."""
        ends = self.ends[which]
        counts = ends - np.where(which > 0, self.ends[which - 1], 0)
        at = np.repeat(ends - np.cumsum(counts), counts) + np.arange(counts.sum())
        return self.data[at], counts


class Alignments:
    """Alignments of units, remembered."""

    def __init__(self, path_a: str, path_b: str, limit: int = TABLE_BYTES):
        self.vocabularies = Vocabularies(path_a, path_b)
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []         # of each unit, as text
        self.unspelt: set[int] = set()      # units whose tokens do not spell them
        self.figures = Lists()              # n_a, n_b, n_groups, n_links of each unit
        self.links = Lists()                # its linked pairs
        self.bytes = 0

    def learn(self, units: list[str]) -> None:
        """Align units and remember them."""
        v = self.vocabularies
        texts = [u.encode() for u in units]
        a, b = v.encode(units)
        flat_a, per_a = _flat(a)
        flat_b, per_b = _flat(b)
        fine = (_spelt(flat_a, per_a, v.bytes_a, v.length_a, texts) &
                _spelt(flat_b, per_b, v.bytes_b, v.length_b, texts))
        kept = np.flatnonzero(fine)
        flat_a, flat_b = flat_a[np.repeat(fine, per_a)], flat_b[np.repeat(fine, per_b)]
        per_a, per_b = per_a[kept], per_b[kept]
        end_a, end_b = np.cumsum(v.length_a[flat_a]), np.cumsum(v.length_b[flat_b])
        cuts = np.union1d(end_a, end_b)     # a link covers the bytes between two neighbouring ends
        at_a, at_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        both = (end_a[at_a] == cuts) & (end_b[at_b] == cuts) if len(cuts) else np.zeros(0, bool)
        pairs = flat_a[at_a] * v.size_b + flat_b[at_b]
        unit = np.repeat(np.arange(len(kept)), per_a)[at_a]
        n_links, n_groups = np.bincount(unit, minlength=len(kept)), np.bincount(unit[both], minlength=len(kept))
        # groups as text: tokens of each side up to the next common end
        says = self._said(flat_a, flat_b, at_a[both] + 1, at_b[both] + 1)
        stops = np.cumsum(n_groups).tolist()
        said = [";".join(says[x:y]) for x, y in zip([0] + stops[:-1], stops)]
        figures = np.zeros((len(units), 4), np.int64)
        figures[kept] = np.stack([per_a, per_b, n_groups, n_links], 1)
        counts = np.zeros(len(units), np.int64)
        counts[kept] = n_links
        self.figures.add(figures.ravel(), np.full(len(units), 4))
        self.links.add(pairs, counts)
        texts_of = dict(zip(kept.tolist(), said))
        for i, u in enumerate(units):
            self.number[u] = len(self.groups)
            if not fine[i]:
                self.unspelt.add(len(self.groups))
            self.groups.append(texts_of.get(i, ""))
        self.bytes += sum(map(len, texts)) + sum(map(len, said)) + 8 * len(pairs) + 250 * len(units)

    @staticmethod
    def _said(flat_a: np.ndarray, flat_b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> list[str]:
        a, b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        out, x, y = [], 0, 0
        for p, q in zip(stop_a.tolist(), stop_b.tolist()):
            out.append((a[x] if p == x + 1 else ",".join(a[x:p])) + "|" + (b[y] if q == y + 1 else ",".join(b[y:q])))
            x, y = p, q
        return out

    def units(self, text: str) -> list[str]:
        """Units of a text, each with the blank or line break that it starts with."""
        if not self.vocabularies.by_unit:
            return [" " + text]
        first, *more = UNIT.split(" " + text)
        return [*([first] if first else []), *[u if u[0] == "\n" else " " + u for u in more]]

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
        """(figures, digests, pairs, times) of documents: the sorted distinct pairs of each and how often it
        links them."""
        if self.bytes > self.limit:
            self.clear()
        split = [self.units(t) if t else [] for t in texts]
        new = list({u for units in split for u in units if u not in self.number})
        if new:
            self.learn(new)
        look = self.number.__getitem__
        numbers = [list(map(look, units)) for units in split]
        for k, held in enumerate(numbers):
            if not self.unspelt.isdisjoint(held):
                whole = " " + texts[k]      # not spelt unit by unit: the tokens of the whole text decide
                if whole not in self.number:
                    self.learn([whole])
                numbers[k] = [look(whole)] if look(whole) not in self.unspelt else []
        says = self.groups.__getitem__
        digests = [hashlib.sha256(";".join(map(says, x)).encode()).hexdigest() if x else "" for x in numbers]
        flat, sizes = _flat(numbers)
        doc = np.repeat(np.arange(len(texts)), sizes)
        figures = np.zeros((len(texts), 4), np.int64)
        if not len(flat):
            return figures, digests, [flat] * len(texts), [flat] * len(texts)
        figures_of = self.figures.data[:4 * self.figures.count].reshape(-1, 4)[flat]
        for k in range(4):
            figures[:, k] = np.bincount(doc, figures_of[:, k], len(texts))
        # units that a document repeats are taken once, with their number
        seen, often = np.unique(doc << 40 | flat, return_counts=True)
        pairs, counts = self.links.of(seen & (1 << 40) - 1)
        owner, weight = np.repeat(seen >> 40, counts), np.repeat(often, counts)
        order = np.lexsort((pairs, owner))
        pairs, owner, weight = pairs[order], owner[order], weight[order]
        starts = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])]))
        times = np.add.reduceat(weight, starts)
        edges = np.searchsorted(owner[starts], np.arange(1, len(texts)))
        return figures, digests, np.split(pairs[starts], edges), np.split(times, edges)


@lru_cache(maxsize=2)
def vocabularies_of(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


@lru_cache(maxsize=2)
def alignments_of(path_a: str, path_b: str) -> Alignments:
    """One table per worker process, kept between the tasks it runs."""
    return Alignments(path_a, path_b)


def _packed(values: np.ndarray) -> bytes:
    """Numbers as byte planes, most of which are empty and compress well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def _slices(column: pa.Array, most: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in lists of about ``most`` characters."""
    out, size = [], 0
    for text in column:
        out.append(text.as_py() or "")
        size += len(out[-1])
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


STAGED = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string",
          "__tw_pairs": "binary", "__tw_times": "binary"}


def _linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``docs`` with the figures, and the links, of each row."""
    kept = without(docs, *ADDED)
    schema = extended(kept.schema, **STAGED)
    source = docs.select(docs["text"].alias("__tw_text"), *[docs[c] for c in kept.columns])

    def run(batches):
        made = alignments_of(path_a, path_b)
        for batch in batches:
            columns: list[list] = [[] for _ in STAGED]
            for texts in _slices(batch.column(0)):
                figures, digests, pairs, times = made.documents(texts)
                for k in range(4):
                    columns[k] += figures[:, k].tolist()
                columns[4] += digests
                columns[5] += [_packed(np.diff(p, prepend=0)) for p in pairs]
                columns[6] += [_packed(t) for t in times]
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             names=schema.names)

    return stage(source.mapInArrow(run, schema).withColumn("__tw_row", F.monotonically_increasing_id()), "linked")


def pair_counts(linked: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(mapped, pair, n): in how many documents ids are linked; for a pair of the identity map, ``pair`` is the
    id of A."""
    def run(batches):
        v = vocabularies_of(path_a, path_b)
        vector = np.zeros(v.size_a, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def rows(mapped, pairs, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), mapped)), pa.array(pairs), pa.array(n)],
                                              names=["mapped", "pair", "n"])

        def flush():
            pairs, n = np.unique(np.concatenate(held or [np.zeros(0, np.int64)]), return_counts=True)
            held.clear()
            for at in range(0, len(pairs), 1 << 16):
                yield rows(False, pairs[at:at + (1 << 16)], n[at:at + (1 << 16)])

        for batch in batches:
            for data in batch.column(0):
                pairs = np.cumsum(_unpacked(data.as_py()))
                a, b = np.divmod(pairs, v.size_b)
                mapped = v.same[a] == b
                vector[a[mapped]] += 1
                held.append(pairs[~mapped])
                size += len(held[-1])
                if size >= HELD:
                    yield from flush()
                    size = 0
        yield from flush()
        met = np.flatnonzero(vector)
        yield rows(True, met, vector[met])

    found = stage(linked.select("__tw_pairs").mapInArrow(run, "mapped boolean, pair long, n long"), "pair-parts")
    return stage(found.groupBy("mapped", "pair").agg(F.sum("n").alias("n")), "pair-counts")


def align(docs: DataFrame, path_a: str, path_b: str, most_pairs: int = PAIRS) -> DataFrame:
    """``docs`` with the columns of ``ADDED``: tokens of both, groups, links, how many links are of the most
    frequent pair of their id of A, the sum of the counts of all links, and a digest of the groups."""
    spark = docs.sparkSession
    kept = without(docs, *ADDED)
    linked = _linked(docs, path_a, path_b)
    counts = pair_counts(linked, path_a, path_b)
    v = vocabularies_of(path_a, path_b)
    # both vectors are as long as the vocabulary
    vector, best = np.zeros(v.size_a, np.int64), np.zeros(v.size_a, np.int64)
    for row in counts.filter("mapped").collect():
        vector[row.pair] = row.n
    off = counts.filter("NOT mapped")
    of_a = F.floor(F.col("pair") / F.lit(v.size_b)).cast("long")
    for row in off.groupBy(of_a.alias("a")).agg(F.max("n").alias("n")).collect():
        best[row.a] = row.n
    vectors = spark.sparkContext.broadcast((vector, np.maximum(vector, best)))
    fewer = off.limit(most_pairs + 1).count() <= most_pairs
    known = None
    if fewer:
        arrow = off.select("pair", "n").toArrow()
        pairs, n = arrow["pair"].to_numpy(), arrow["n"].to_numpy()
        order = np.argsort(pairs)
        known = spark.sparkContext.broadcast((pairs[order], n[order]))

    def sums(batches):
        """(row, n_best, count_sum) over the links whose counts are at hand."""
        v = vocabularies_of(path_a, path_b)
        vector, best = vectors.value
        for batch in batches:
            out = []
            for data, often in zip(batch.column(1), batch.column(2)):
                pairs, times = np.cumsum(_unpacked(data.as_py())), _unpacked(often.as_py())
                a, b = np.divmod(pairs, v.size_b)
                mapped = v.same[a] == b
                n = np.where(mapped, vector[a], 0)
                if known is not None and len(known.value[0]):
                    at = np.searchsorted(known.value[0], pairs[~mapped])
                    n[~mapped] = known.value[1][at]
                here = mapped if known is None else np.ones(len(n), bool)
                out.append((int(times[here & (n == best[a])].sum()), int((times * n).sum())))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[3:], batch.column(0), *[pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)]],
                names=schema.names)

    plain = linked.drop("__tw_pairs", "__tw_times", "__tw_row")
    schema = extended(plain.schema, __tw_row="long", n_best="long", count_sum="long")
    done = linked.select("__tw_row", "__tw_pairs", "__tw_times", *plain.columns).mapInArrow(sums, schema)
    if fewer:
        return done.select(*kept.columns, *ADDED)

    def links(batches):
        v = vocabularies_of(path_a, path_b)
        for batch in batches:
            for row, data, often in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                pairs, times = np.cumsum(_unpacked(data.as_py())), _unpacked(often.as_py())
                a, b = np.divmod(pairs, v.size_b)
                other = v.same[a] != b
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(other.sum()), row)), pa.array(pairs[other]),
                                                  pa.array(times[other])], names=["__tw_row", "pair", "times"])

    def marked(batches):
        best, size_b = vectors.value[1], vocabularies_of(path_a, path_b).size_b
        for batch in batches:
            pairs, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n == best[pairs // size_b])],
                                             names=["pair", "n", "top"])

    rows = linked.select("__tw_row", "__tw_pairs", "__tw_times").mapInArrow(links, "__tw_row long, pair long, times long")
    shares = rows.join(off.select("pair", "n").mapInArrow(marked, "pair long, n long, top boolean"), "pair").groupBy(
        "__tw_row").agg(F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("more_best"),
                        F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    zero = F.lit(0)
    return done.join(shares, "__tw_row", "left").withColumn(
        "n_best", F.col("n_best") + F.coalesce("more_best", zero)).withColumn(
        "count_sum", F.col("count_sum") + F.coalesce("more_sum", zero)).select(*kept.columns, *ADDED)


@query("op13_alignment")
def op13_alignment(spark, folder):
    """Token alignments of the whole `documents` between the two public vocabularies."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"),
                 public_tokenizers.path("piece_bpe_32k.model")).drop("text")
