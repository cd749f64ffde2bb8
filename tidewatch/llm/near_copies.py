"""Near copies by min-max hashing.

A document's set holds its distinct five-word shingles.  Under each random permutation of the hash space both
the smallest and the largest member are kept: either one agrees between two sets with a probability equal to
their similarity, so every permutation gives two signature values for one evaluation.  Values are banded
(``ROWS`` per band, bands enough to miss a pair at the threshold with a chance below ``MISS``); documents that
share a band are compared, and a link is confirmed on the full sets.

How the work is kept linear and whole:

* Documents with equal sets form one class; only classes are compared, so copies are never expanded.
* A band value that two classes share gives that pair.  The classes of a more common value are dealt into
  blocks of bounded size.  First, each pair of blocks names, by the signatures held, a forest of the most
  similar pairs: as many rows as classes at most.  These are confirmed and joined into components.
* A second pass over the values whose classes are still in several components finds the classes with a
  plausible partner in another one and compares them, inside the blocks, on the full sets, until each pair
  is joined or refuted.  No link between different texts is lost and pairs are never emitted in bulk.

"Plausible" is six standard deviations below the threshold in the share of equal signature values.

Defined cases: null and empty texts, and texts of blanks, have an empty set, no links and are their own
component; shorter texts than a shingle have one shingle of all their words; rows without an id are never
linked, have no component and are kept; rows that repeat an id are separate documents of that id; equal
similarities need no tie rule as every link counts; an empty table gives an empty result; further columns are
ignored by ``near_copies`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import extended, query, runs, table
from tidewatch.llm.components import components
from tidewatch.llm.shingles import mix, shingle_set, words
from tidewatch.session import stage

ROWS = 6                    # signature values per band, half of them minima
MISS = 5e-7
BLOCK = 512                 # classes in a block
BROADCAST_ROWS = 1_000_000  # of 24 bytes
SPREAD = 6.0                # standard deviations


def bands_for(percent: int) -> int:
    alike = (percent / 100) ** ROWS
    return max(1, math.ceil(math.log(MISS) / math.log1p(-alike))) if alike < 1 else 1


def plausible_matches(percent: int) -> int:
    """Equal signature values that a linked pair has at least, but for a chance of about one in 10**9."""
    n, p = bands_for(percent) * ROWS, percent / 100
    return max(0, math.floor(n * p - SPREAD * math.sqrt(n * p * (1 - p))))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(907)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(
        0, 2**63, n, dtype=np.uint64)


def min_max(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """One row per (non-empty) set: the minima under all permutations, then the maxima.

    Both of one permutation agree less often than two independent values would (3 in 5, not 0.64, for 4 of 5 members
    shared).  Apart, the values of a band are independent, and bands miss a pair together no more often than
    independent ones."""
    scale, shift = _permutations(permutations)
    out = np.empty((len(sets), 2 * permutations), np.uint64)
    first, size = 0, 0
    for i, s in enumerate(sets):
        size += len(s)
        if size > 1 << 16 or i == len(sets) - 1:
            part = sets[first:i + 1]
            at = np.cumsum([0] + [len(x) for x in part[:-1]])
            members = np.concatenate(part)
            for p in range(permutations):
                placed = members * scale[p] + shift[p]
                out[first:i + 1, p] = np.minimum.reduceat(placed, at)
                out[first:i + 1, permutations + p] = np.maximum.reduceat(placed, at)
            first, size = i + 1, 0
    return out


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [shingle_set(w) for w in words([(t or "").encode() for t in column.to_pylist()])]


def _node(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, node, bands, marks): set size, 128-bit name of the set, a hash per band, and the lowest
    byte of every signature value."""
    bands = bands_for(percent)
    step = np.random.default_rng(31).integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for batch in batches:
            sets = _sets(batch.column(1))
            full = [i for i, s in enumerate(sets) if len(s)]
            values = min_max([sets[i] for i in full], bands * ROWS // 2)
            keys = mix((values.reshape(-1, bands, ROWS) * step).sum(2, dtype=np.uint64)
                       + np.arange(bands, dtype=np.uint64)).view(np.int64)
            marks = mix(values).astype(np.uint8)
            place = dict(zip(full, range(len(full))))
            at = [place.get(i) for i in range(len(sets))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([None if j is None else _node(s) for s, j in zip(sets, at)], pa.binary()),
                 pa.array([None if j is None else keys[j] for j in at], pa.list_(pa.int64())),
                 pa.array([None if j is None else marks[j].tobytes() for j in at], pa.binary())],
                names=["doc_id", "n", "node", "bands", "marks"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n long, node binary, bands array<long>, marks binary")


class _Forest:
    """Joined classes of a block."""

    def __init__(self, labels: list):
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]
        self.left = len(first)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        self.left -= 1
        return True


def _plausible(group: pa.Table, percent: int):
    """Yields (i, js, equal values of each) for the rows of a block pair that may be linked and have different
    labels; rows of one block are compared with each other only in the pair of the block with itself."""
    marks = np.frombuffer(b"".join(group["marks"].to_pylist()), np.uint8).reshape(group.num_rows, -1)
    sizes = group["n"].to_numpy()
    label = np.unique(np.array(group["label"].to_pylist(), dtype="S16"), return_inverse=True)[1]
    chunk = group["chunk"].to_numpy()
    apart = group["bi"][0].as_py() != group["bj"][0].as_py()
    least = plausible_matches(percent)
    for i in range(len(marks) - 1):
        js = np.arange(i + 1, len(marks))
        fit = (label[js] != label[i]) & (100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i]))
        if apart:
            fit &= chunk[js] != chunk[i]
        js = js[fit]
        if len(js):
            same = (marks[js] == marks[i]).sum(1)
            good = same >= least
            if good.any():
                yield i, js[good], same[good]


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _blocks(members: DataFrame, extra: list[str]) -> DataFrame:
    """Members (key, c, node, ..) dealt into pairs of blocks, sorted for ``runs`` by (key, bi, bj)."""
    cut = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = members.withColumn("cuts", cut).withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return dealt.select("key", F.least("chunk", "other").alias("bi"), F.greatest("chunk", "other").alias("bj"),
                        "chunk", "node", *extra).repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")


BLOCK_KEYS = ["key", "bi", "bj"]


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast hint for a written table, if its rows have been counted to be few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, members) of the wanted nodes, from the text of one document of each class."""
    ids = _bounded(stage(classes.join(wanted, "node", "left_semi").select(F.col("rep").alias("doc_id"), "node"),
                         "wanted"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids, "doc_id")

    def run(batches):
        for batch in batches:
            sets = _sets(batch.column("text"))
            hit = [(n, s) for n, s in zip(batch.column("node").to_pylist(), sets) if _node(s) == n]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in hit], pa.binary()),
                                              pa.array([s.tobytes() for _, s in hit], pa.binary())],
                                             names=["node", "members"])

    # an id that several rows repeat may give a set twice
    return stage(texts.mapInArrow(run, "node binary, members binary").dropDuplicates(["node"]), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("members").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            keep = [i for i, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()))
                    if _linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))],
                                             names=["a", "b"])

    return full.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _name_forest(percent: int):
    """A forest of the most similar plausible pairs of each block pair: every tree takes its best pair to another
    tree until none is left (Boruvka)."""
    def run(batches):
        for group in runs(batches, BLOCK_KEYS):
            same = np.zeros((group.num_rows, group.num_rows), np.uint16)
            for i, js, equal in _plausible(group, percent):
                same[i, js] = same[js, i] = equal
            nodes, forest = group["node"].to_pylist(), _Forest(list(range(group.num_rows)))
            pairs = []
            while True:
                tree = np.array([forest.root(i) for i in range(group.num_rows)])
                same[tree[:, None] == tree[None, :]] = 0
                best = same.argmax(1)
                most = same[np.arange(len(best)), best]
                order = np.lexsort((-most.astype(np.int64), tree))
                first = order[np.concatenate([[True], tree[order][1:] != tree[order][:-1]])]
                first = first[most[first] > 0]
                if not len(first):
                    break
                pairs += [sorted((nodes[i], nodes[best[i]])) for i in first.tolist() if forest.join(i, int(best[i]))]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()),
                                              pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])
    return run


def _name_open(percent: int):
    def run(batches):
        for group in runs(batches, BLOCK_KEYS):
            seen = np.zeros(group.num_rows, bool)
            for i, js, _ in _plausible(group, percent):
                seen[i] = seen[js] = True
            rows = pa.array(np.flatnonzero(seen), pa.int64())
            for batch in group.select([*BLOCK_KEYS, "node"]).take(rows).to_batches():
                yield batch
    return run


def _compare_open(percent: int):
    def run(batches):
        for group in runs(batches, BLOCK_KEYS):
            nodes = group["node"].to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in group["members"].to_pylist()]
            forest = _Forest(group["label"].to_pylist())
            pairs = []
            for i, js, _ in _plausible(group, percent):
                for j in js.tolist():
                    if forest.root(i) != forest.root(j) and _linked(sets[i], sets[j], percent):
                        forest.join(i, j)
                        pairs.append((nodes[i], nodes[j]))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()),
                                              pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])
    return run


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n_shingles, node, label, component_id) per document; the label is one of the component's nodes."""
    signed = stage(signatures(docs, percent), "signed")
    classes = stage(signed.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.first("marks").alias("marks")), "classes")
    keyed = classes.select("node", F.explode("bands").alias("key"))
    shared = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("a"),
                                            F.max("node").alias("b")).filter("c > 1"), "shared")
    held = classes.select("node", "n", "marks")
    common = stage(keyed.join(shared.filter("c > 2").select("key", "c"), "key").join(held, "node"), "common")

    twos = shared.filter("c = 2").select("a", "b")
    forest = _blocks(common.withColumn("label", F.col("node")), ["n", "marks", "label"]).mapInArrow(
        _name_forest(percent), "a binary, b binary")
    pairs = stage(twos.unionByName(forest).distinct(), "pairs")
    sets = _full_sets(docs, classes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    links = stage(_confirm(pairs, sets, percent), "links")
    labels = components(links, "a", "b")

    # what band values still hold together although its components are apart
    named = common.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    still = stage(named.join(apart, "key", "left_semi"), "still")
    loose = stage(_blocks(still, ["n", "marks", "label"]).mapInArrow(
        _name_open(percent), "key long, bi int, bj int, node binary"), "loose")
    wanted = loose.select("node").distinct()
    more = _full_sets(docs, classes, wanted)
    # the block pairs are as before; only their loose classes take part
    open_ = loose.join(still.select("key", "node", "c", "n", "marks", "label"), ["key", "node"]).join(
        more, "node").withColumn("chunk", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / BLOCK).cast("int")).cast("int"))
    late = stage(open_.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS).mapInArrow(
        _compare_open(percent), "a binary, b binary"), "late")
    labels = components(links.unionByName(late), "a", "b")

    grouped = classes.select("node", "rep").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    least = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = grouped.join(least, "label").select("node", "label", "component_id")
    own = signed.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return own.select("doc_id", "n_shingles", "node", "label", component.alias("component_id"))


def near_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document: documents are linked when 100 times the size of
    their sets' intersection is at least ``percent`` times that of their union; a component's id is its
    smallest document id, and that document is kept."""
    return _grouped(docs, percent).select("doc_id", "n_shingles", "component_id", F.coalesce(
        F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _with_node(docs: DataFrame) -> DataFrame:
    """``docs`` with __tw_id and __tw_node: the id as a number, and the name of the text's set, empty for no set."""
    schema = extended(docs.schema, __tw_id="long", __tw_node="binary")
    source = docs.select(docs["text"].cast("string").alias("__tw_text"), *[docs[c] for c in docs.columns],
                         docs["doc_id"].cast("long").alias("__tw_id"))

    def run(batches):
        for batch in batches:
            nodes = [_node(x) if len(x) else b"" for x in _sets(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(nodes, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


def drop_near_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id, and one row of it.  Rows of one id whose
    texts are in different groups are decided each by its own group."""
    found = _grouped(docs, percent).filter("doc_id = component_id").select(
        F.col("doc_id").alias("__tw_id"), F.coalesce("node", F.lit(b"")).alias("__tw_node"), "label")
    # of linked texts under the smallest id one stays
    chosen = found.groupBy("__tw_id", "label").agg(F.min("__tw_node").alias("__tw_node")).drop("label")
    key = ["__tw_id", "__tw_node"]
    stay = _with_node(docs.filter(F.col("doc_id").cast("long").isNotNull())).join(chosen, key, "left_semi")
    return stay.dropDuplicates(key).select(*docs.columns).unionByName(
        docs.filter(F.col("doc_id").cast("long").isNull()))


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
    GROUP BY 1, 2),
l AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id AND r.c < e.b),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("op9_near_copies", SQL)
def op9_near_copies(spark, folder):
    """Components of near copies over whole `documents`, at a similarity of 0.85."""
    return near_copies(table(spark, folder, "documents", "doc_id", "text"), 85)
