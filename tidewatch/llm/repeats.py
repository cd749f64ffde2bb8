"""Removal of byte strings that occur more than once, found by sorting suffixes of a difference cover.

A difference cover modulo ``v`` is a set of residues such that any two positions i and j have a common shift
below ``v`` that brings both into the set.  If a string of ``length`` bytes starts at i and at j, then the
strings of ``length - v + 1`` bytes at some two cover positions inside are equal as well.  So:

1. the suffixes at cover positions (about 6 % of all for 400 bytes) are dealt into buckets by the fingerprint
   of their next ``length - v + 1`` bytes, and one bucket at a time is sorted; equal ones share a rank.  Cover
   positions whose rank is theirs alone are dropped;
2. only the up to ``v`` suffixes before a shared rank can start a repeated string.  They are dealt into buckets
   by the fingerprint of their whole ``length`` bytes, sorted one bucket at a time, and equal neighbours are
   marked.

Only equality matters, so suffixes are ordered by fingerprint and a long tie is one comparison.  A bucket holds
about ``BUCKET`` suffixes whatever the input.  A map task sends one suffix of each fingerprint it has met and
marks the others itself, so a passage that very many documents share reaches a bucket once per batch of
documents only.  Equal texts are judged once: if they are long enough, every byte of them is covered.

The fingerprints of step 2 have 56 bits beside the bucket's: a false mark has a chance of about 3 in 10**11 per
suffix looked at.  Those of step 1 are shorter, since a false one only costs work.

Defined cases: null texts are empty; texts shorter than ``length`` lose nothing, but for none; occurrences may
overlap and may lie in one document; every occurrence goes, the first one too; rows that repeat an id and
text are separate occurrences; matches never cross documents; an empty table gives an empty result; further
columns are kept by ``remove_repeats`` and columns it adds replace those of the same name.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import extended, query, runs, table, utf8, without
from tidewatch.llm.shingles import _BASE, mix
from tidewatch.session import stage

BUCKET = 3_000_000          # suffixes that are sent to one place
PASSES = 4                  # in which they are sorted there, a share of the fingerprints each
SEGMENT = 1 << 19           # bytes hashed at once
BROADCAST_ROWS = 1_000_000  # of 16 bytes, or of three numbers each
SHORT, LONG = 4, 7          # bytes of a fingerprint in the two steps
_CODES = np.random.default_rng(411).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def difference_cover(length: int) -> tuple[int, np.ndarray]:
    """(v, residues) with v at most four fifths of ``length``: for the largest fitting prime q, the q + 1 powers
    of an element of the field of q**3 members that have no quadratic part, modulo v = q * q + q + 1.  Every
    difference modulo v then occurs exactly once."""
    fitting = [q for q in range(2, math.isqrt(length) + 1)
               if all(q % p for p in range(2, q)) and 5 * (q * q + q + 1) <= 4 * length]
    if not fitting:
        return 1, np.zeros(1, np.int64)
    q = fitting[-1]
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, found = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        found.append(i)
                    x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
                if len(found) == q + 1 and len({(i - j) % v for i in found for j in found}) == v:
                    return v, np.array(found)
    raise ValueError(q)


def fingerprints(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit fingerprints of the ``length`` bytes from each of the ascending ``starts``."""
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        base = int(starts[done])
        upto = int(np.searchsorted(starts, base + SEGMENT))
        here = starts[done:upto] - base
        up, down = _powers_to(int(here[-1]) + length)
        total = np.zeros(int(here[-1]) + length + 1, np.uint64)
        np.cumsum(_CODES[raw[base:base + len(total) - 1]] * up, out=total[1:])
        out[done:upto] = mix((total[here + length] - total[here]) * down[here])
        done = upto
    return out


_held: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _held or len(_held[0]) < n:
        _held[:] = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(max(n, SEGMENT + 4096), base, np.uint64)
            steps[0] = 1
            _held.append(np.multiply.accumulate(steps))
    return _held[0][:n], _held[1][:n]


def cover_positions(n: int, length: int, v: int, cover: np.ndarray) -> np.ndarray:
    """Cover positions of a text of ``n`` bytes that have enough bytes behind them."""
    if n < length:
        return np.zeros(0, np.int64)
    at = (np.arange(0, n, v)[:, None] + cover).ravel()
    return at[at <= n - (length - v + 1)]


def starts_before(shared: np.ndarray, n: int, length: int, v: int) -> np.ndarray:
    """Starts of strings of ``length`` bytes that hold one of the ``shared`` cover positions suitably."""
    change = np.zeros(n - length + 2, np.int64)
    np.add.at(change, np.clip(shared - v + 1, 0, None), 1)
    np.add.at(change, np.minimum(shared, n - length) + 1, -1)
    return np.flatnonzero(np.cumsum(change)[:-1] > 0)


PACKED = "bucket int, known boolean, docs binary, counts binary, places binary, prints binary"
FOUND = "part int, docs binary, counts binary, places binary"
PLACES = "name binary, places binary"


def _planes(values: np.ndarray, width: int) -> bytes:
    """Numbers as byte planes, so that the shuffle's compression sees the empty high bytes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


class _Packer:
    """Suffixes (document, place, fingerprint) of many documents, packed per bucket."""

    def __init__(self, buckets: int, width: int, most: int = 1 << 19):
        self.buckets, self.width, self.most = buckets, width, most
        self.clear()

    def clear(self) -> None:
        self.names: dict[bytes, None] = {}
        self.parts: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, name: bytes, places: np.ndarray, prints: np.ndarray):
        """The packed batch, when enough has come together."""
        if name not in self.names and len(places):
            self.names[name] = None
            self.parts.append((len(self.names) - 1, places, prints))
            self.size += len(places)
        if self.size >= self.most:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        names = list(self.names)
        doc = np.repeat(np.array([p[0] for p in self.parts], np.int64), [len(p[1]) for p in self.parts])
        place = np.concatenate([p[1] for p in self.parts] or [np.zeros(0, np.int64)])
        prints = np.concatenate([p[2] for p in self.parts] or [np.zeros(0, np.uint64)])
        self.clear()
        order = np.argsort(prints, kind="stable")
        new = np.concatenate([[True], prints[order][1:] != prints[order][:-1]])[:len(order)]
        run = np.cumsum(new) - 1
        often = np.bincount(run, minlength=1)[run] > 1 if len(run) else new
        first = np.zeros(len(order), bool)
        first[order[new]] = True
        known = np.zeros(len(order), bool)
        known[order[often]] = True
        bucket = (prints % np.uint64(self.buckets)).astype(np.int64)
        chosen = np.flatnonzero(first)
        by = chosen[np.argsort(bucket[chosen], kind="stable")]
        rows = [(int(bucket[x[0]]), False, x) for x in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(x)]
        # those already known to occur twice need no bucket; the one that is sent speaks for the others
        rows.append((int(bucket[0]) if len(bucket) else 0, True, np.flatnonzero(known)))
        out: list[list] = [[] for _ in range(6)]
        for b, sure, at in rows:
            if not len(at):
                continue
            which, counts = np.unique(doc[at], return_counts=True)
            values = (b, sure, b"".join(names[i] for i in which), _planes(counts, 4),
                      _planes(np.diff(place[at], prepend=0), 8),
                      b"" if sure else _planes((prints[at] // np.uint64(self.buckets)), self.width))
            for column, value in zip(out, values):
                column.append(value)
        kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                          names=["bucket", "known", "docs", "counts", "places", "prints"])


def _dealt(own: np.ndarray, names: list[bytes], parts: int) -> pa.RecordBatch:
    """Packed rows of marked suffixes, given as (document << 32 | place), by part of the documents."""
    part = np.array([int.from_bytes(n[:4], "little") % parts for n in names], np.int64)
    order = np.argsort(part, kind="stable")                 # documents of a part next to each other
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    own = np.sort(rank[own >> 32] << 32 | own & 0xFFFFFFFF)
    which, counts = np.unique(own >> 32, return_counts=True)
    of = part[order[which]]
    cuts = np.flatnonzero(np.diff(of)) + 1
    ends = np.cumsum(counts)
    out: list[list] = [[], [], [], []]
    for docs, n in zip(np.split(np.arange(len(which)), cuts), np.split(counts, cuts)) if len(which) else ():
        places = own[ends[docs[0]] - counts[docs[0]]:ends[docs[-1]]] & 0xFFFFFFFF
        for column, value in zip(out, (int(of[docs[0]]), b"".join(names[order[which[d]]] for d in docs), _planes(n, 4),
                                       _planes(np.diff(places, prepend=0), 8))):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]],
                                      names=["part", "docs", "counts", "places"])


def _rows(group: pa.Table):
    for batch in group.to_batches(max_chunksize=1):
        yield from batch.to_pylist()


def _by_known(batches):
    """(known, rows) of packed batches sorted by bucket and known: the rows that need it as one table per bucket, those
    already known to be shared as they come, a batch at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        for group in runs([batch], ["bucket", "known"]):
            bucket, known = group["bucket"][0].as_py(), group["known"][0].as_py()
            if held and (known or bucket != last):
                whole, held = pa.Table.from_batches(held), []
                yield False, whole
                del whole                       # before the next one is gathered
            if known:
                yield True, group
            else:
                held, last = held + group.to_batches(), bucket
            del group
    if held:
        yield False, pa.Table.from_batches(held)


def _joined(rows, number: dict[bytes, int], width: int = 0, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(document << 32 | place, fingerprints) of packed rows; a document has its ``number`` throughout.  With a
    ``width``, only the fingerprints whose turn it is."""
    own, prints = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for row in rows:
        names = [row["docs"][i:i + 16] for i in range(0, len(row["docs"]), 16)]
        local = np.array([number.setdefault(n, len(number)) for n in names], np.int64)
        doc = np.repeat(local, _numbers(row["counts"], 4).astype(np.int64))
        mine = doc << 32 | np.cumsum(_numbers(row["places"], 8).view(np.int64))
        if width:
            values = _numbers(row["prints"], width)
            now = np.flatnonzero(values % np.uint64(PASSES) == turn)
            mine, values = mine[now], values[now]
            prints.append(values)
        own.append(mine)
    return np.concatenate(own), np.concatenate(prints)


def _repeated(packed: DataFrame, buckets: int, width: int) -> DataFrame:
    """(name, places) of the suffixes that are not alone with their fingerprint, one row per document."""
    def shared_of(group: pa.Table) -> tuple[np.ndarray, list[bytes]]:
        """The suffixes of a bucket that are not alone, and the documents they are numbered by."""
        number: dict[bytes, int] = {}
        marked = [np.zeros(0, np.int64)]
        for turn in range(PASSES):
            own, prints = _joined(_rows(group), number, width, turn)
            if not len(own):
                continue
            order = np.argsort(prints, kind="stable")
            prints, own = prints[order], own[order]
            start = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
            shared = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)
            marked.append(own[np.repeat(shared, np.diff(np.append(start, len(own))))])
        return np.concatenate(marked), list(number)

    def mark(batches):
        for known, rows in _by_known(batches):
            if known:
                for row in _rows(rows):         # as they come: there may be as many as there are suffixes
                    number: dict[bytes, int] = {}
                    own = _joined([row], number)[0]
                    yield _dealt(own, list(number), buckets)
            else:
                own, names = shared_of(rows)
                del rows                        # its buffers go before the marks are packed
                pa.default_memory_pool().release_unused()
                yield _dealt(own, names, buckets)

    def gather(batches):
        for group in runs(batches, ["part"]):
            number: dict[bytes, int] = {}
            parts = [np.zeros(0, np.int64)]
            for row in _rows(group):
                parts.append(_joined([row], number)[0])
            del group, row
            pa.default_memory_pool().release_unused()
            own = np.unique(np.concatenate(parts))
            names = list(number)
            del parts, number
            which, first = np.unique(own >> 32, return_index=True)
            for at in range(0, len(which), 1000):
                docs = which[at:at + 1000]
                ends = np.append(first[1:], len(own))[at:at + 1000]
                blobs = [_planes(np.diff(own[a:b] & 0xFFFFFFFF, prepend=0), 4) for a, b in zip(first[at:at + 1000], ends)]
                yield pa.RecordBatch.from_arrays([pa.array([names[d] for d in docs], pa.binary()),
                                                  pa.array(blobs, pa.binary())], names=["name", "places"])

    marked = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "known").mapInArrow(mark, FOUND)
    return marked.repartition(buckets, "part").sortWithinPartitions("part").mapInArrow(gather, PLACES)


def _places(data: bytes) -> np.ndarray:
    """The places of a document, in order."""
    return np.cumsum(_numbers(data, 4).view(np.int64))


def _name(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _few(df: DataFrame, size: Column | None = None) -> bool:
    rows = df.agg(F.coalesce(F.sum(size if size is not None else F.lit(1)), F.lit(0))).first()[0]
    return rows <= BROADCAST_ROWS


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(name, spans) for each distinct text that loses bytes; ``name`` is the first 16 bytes of its SHA-256 and
    a span is a maximal run [start, end) of covered bytes."""
    v, cover = difference_cover(length)
    short = length - v + 1
    texts = docs.select(F.col("doc_id").cast("long"), utf8().alias("raw")).filter(F.octet_length("raw") >= length)
    named = stage(texts.select("doc_id", _name(F.col("raw")).alias("name"), F.octet_length("raw").alias("n")), "texts")
    copied = stage(named.groupBy("name").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"),
                                             F.max("n").alias("n")).filter("copies > 1"), "copied")
    others = stage(named.join(copied, "name").filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select(
        "doc_id", "name"), "others")
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    source = texts.withColumn("name", _name(F.col("raw")))
    once = source.join(F.broadcast(others) if _few(others) else others,
                       source["doc_id"].eqNullSafe(others["doc_id"]) & (source["name"] == others["name"]),
                       "left_anti").select("name", "raw")

    def sample(batches):
        pack = _Packer(buckets, SHORT)
        for batch in batches:
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("raw")):
                raw = np.frombuffer(raw.as_buffer(), np.uint8)
                at = cover_positions(len(raw), length, v, cover)
                yield from pack.add(name, at, fingerprints(raw, at, short))
        yield pack.flush()

    buckets = max(1, math.ceil(total * len(cover) / v / BUCKET))
    shared = stage(_repeated(once.mapInArrow(sample, PACKED), buckets, SHORT), "shared")

    def reach(batches):
        for batch in batches:
            sizes = [int(np.minimum(np.diff(_places(p), prepend=-1), v).sum()) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(sizes)], pa.int64())], names=["size"])

    wide = shared.select("places").mapInArrow(reach, "size long").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    wide = max(1, math.ceil(wide / BUCKET))
    names = shared.select("name")
    near = once.join(F.broadcast(names) if _few(names) else names, "name", "left_semi").join(shared, "name")

    def suffixes(batches):
        pack = _Packer(wide, LONG)
        for batch in batches:
            for name, raw, places in zip(batch.column("name").to_pylist(), batch.column("raw"),
                                         batch.column("places").to_pylist()):
                raw = np.frombuffer(raw.as_buffer(), np.uint8)
                at = starts_before(_places(places), len(raw), length, v)
                yield from pack.add(name, at, fingerprints(raw, at, length))
        yield pack.flush()

    starts = _repeated(near.select("name", "raw", "places").mapInArrow(suffixes, PACKED), wide, LONG)

    def spans(batches):
        for batch in batches:
            found = []
            for places in batch.column("places").to_pylist():
                at = _places(places)
                cut = np.flatnonzero(np.diff(at) > length) + 1
                edges = zip(at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])] + length)
                found.append([{"start": int(a), "end": int(b)} for a, b in edges])
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(found, pa.list_(pa.struct(
                [("start", pa.int64()), ("end", pa.int64())])))], names=["name", "spans"])

    part = starts.mapInArrow(spans, "name binary, spans array<struct<start:long,end:long>>").join(
        copied, "name", "left_anti")
    whole = copied.select("name", F.array(F.struct(F.lit(0).cast("long").alias("start"),
                                                   F.col("n").cast("long").alias("end"))).alias("spans"))
    return stage(part.unionByName(whole), "spans")


ADDED = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_bytes": "binary", "kept_sha256": "string"}


def remove_repeats(docs: DataFrame, length: int = 400, add: tuple[str, ...] = tuple(ADDED)) -> DataFrame:
    """``docs`` with the columns named in ``add``: bytes of the text, how many of them are removed and in how
    many runs, what remains, and its SHA-256."""
    kept = without(docs, *add)
    found = repeated_spans(docs, length)
    found = F.broadcast(found) if _few(found, F.size("spans")) else found
    raw = utf8().alias("__tw_raw")
    source = docs.select(*[docs[c] for c in kept.columns], raw, _name(raw).alias("__tw_name"))
    joined = source.join(found.select(F.col("name").alias("__tw_name"), F.col("spans").alias("__tw_spans")), "__tw_name", "left")
    schema = extended(kept.schema, **{c: ADDED[c] for c in add})
    columns = len(kept.columns)

    def run(batches):
        for batch in batches:
            made: dict[str, list] = {c: [] for c in add}
            for raw, spans in zip(batch.column(columns), batch.column(columns + 1).to_pylist()):
                raw, spans = raw.as_py(), spans or []
                left = b"".join(raw[a:b] for a, b in zip([0] + [s["end"] for s in spans],
                                                         [s["start"] for s in spans] + [len(raw)])) if spans else raw
                values = {"n_bytes": len(raw), "n_removed": len(raw) - len(left), "n_spans": len(spans)}
                for c in add:
                    made[c].append(values[c] if c in values else left if c == "kept_bytes" else
                                   hashlib.sha256(left).hexdigest())
            kinds = {"kept_bytes": pa.binary(), "kept_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:columns], *[pa.array(made[c], kinds.get(c, pa.int64())) for c in add]],
                names=schema.names)

    return joined.select(*kept.columns, "__tw_raw", "__tw_spans").mapInArrow(run, schema)


@query("op10_repeats")
def op10_repeats(spark, folder):
    """What remains of each of the whole `documents` without the 400-byte strings that occur again."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    return remove_repeats(docs, 400, ("n_bytes", "n_removed", "n_spans", "kept_sha256")).drop("text")
