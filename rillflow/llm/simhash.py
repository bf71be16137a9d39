"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits. The binary
[23, 12] Golay code is perfect: every word of 23 bits has one codeword within three
bits. Two fingerprints at most ``LINK`` = 4 bits apart have, by pigeonhole, a pair of
segments with at most two errors between them, so that some word lies within one bit
of both there. A fingerprint therefore takes, for each pair of segments, as keys the
codeword indices of itself and of all words one bit away: two decodes of 12 bits make
a key, about ten keys a pair, and no link is missed. Rows with equal keys meet in one
bucket; every pair of a bucket is verified, but a task passes on only a spanning
forest of the links it found. Components follow by alternating star contraction.

Equal fingerprints are one node, so that groups of copies never meet in a bucket. A
fingerprint, node or component of more than 1/1024 of the rows is joined map side.

A bucket is one of 3 x 2^24, so that it holds about 29 / 5e7 of the distinct
fingerprints, and pairs grow with the square: 10^10 distinct fingerprints make buckets of
5,800 rows and 8e14 comparisons of 8 bytes each, some hours of a thousand cores.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; a
very long text is hashed whole, with some 30 bytes of memory a byte; a null ``doc_id`` is
ignored for component ids unless the whole component has none; repeated rows share a
component; of rows that tie on ``doc_id`` and text one stays; an empty table gives no
rows; other columns are ignored, or carried along by :func:`keep_one`.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, join_hot

WORDS, LINK, SEED = 4, 4, 42
#: Widths of the segments, and the pairs of them that make keys.
WIDTHS = (22, 21, 21)
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the [23, 12] Golay code (a fixed value).
GENERATOR = 0xC75
#: Bucket rows compared at a time, and links kept before a task contracts them.
BLOCK, PENDING = 512, 1 << 18

_WEIGHT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes) -> int:
    """Fingerprint of one whole text in UTF-8, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size).tolist()
    digest = xxhash.xxh64_digest
    shingles = [digest(whole[i:j], SEED) for i, j in zip(start, end[WORDS - 1 :].tolist())] or [digest(whole, SEED)]
    octets = np.frombuffer(b"".join(shingles), np.uint8).reshape(-1, 8)
    seen = np.bincount((octets + _PLACES).ravel(), minlength=2048).reshape(8, 256)
    bits = (seen @ _WEIGHT).ravel() * 2 > len(shingles)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


_PLACES = np.arange(8, dtype=np.int64) * 256


@F.arrow_udf(T.LongType())
def fingerprints(text: pa.Array) -> pa.Array:
    parts = (text.slice(i, 200).cast(pa.binary()).to_pylist() for i in range(0, len(text), 200))
    values = np.array([fingerprint(x or b"") for part in parts for x in part], np.uint64)
    return pa.array(values.view(np.int64))


@functools.lru_cache(maxsize=1)
def decoder() -> np.ndarray:
    """The index of the codeword nearest to each word of 23 bits."""
    words = np.zeros(4096, np.int64)
    for k in range(12):
        words[(np.arange(4096) >> k & 1) == 1] ^= GENERATOR << k
    table = np.empty(1 << 23, np.uint16)
    bit = [1 << i for i in range(23)]
    errors = [0, *bit, *(a | b for a in bit for b in bit if a < b), *(a | b | c for a in bit for b in bit if a < b for c in bit if b < c)]
    for e in errors:
        table[words ^ e] = np.arange(4096, dtype=np.uint16)
    return table


def segment_indices(values: np.ndarray, width: int) -> np.ndarray:
    """Codeword indices of each value and, in the next columns, of the words one bit away."""
    table = decoder()
    return np.stack([table[values], *(table[values ^ (1 << b)] for b in range(width))], axis=1).astype(np.int64)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of the fingerprint) of every key, each key once for a fingerprint."""
    shifts = [sum(WIDTHS[:i]) for i in range(3)]
    near = [segment_indices((prints >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64), w) for s, w in zip(shifts, WIDTHS)]
    keys, rows = [], []
    for k, (i, j) in enumerate(PAIRS):
        a, b = near[i], near[j]
        both = np.concatenate([(a << 12) | b[:, :1], (a[:, :1] << 12) | b[:, 1:]], axis=1) | (k << 24)
        both.sort(axis=1)
        new = np.ones(both.shape, bool)
        new[:, 1:] = both[:, 1:] != both[:, :-1]
        keys.append(both[new])
        rows.append(np.nonzero(new)[0])
    return np.concatenate(keys), np.concatenate(rows)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as those of links a-b, as links of each node to its least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


class Found:
    """Links found so far; contracted to a forest whenever they double beyond PENDING."""

    def __init__(self):
        self.a, self.b, self.size, self.kept = [], [], 0, 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.size += len(a)
            if self.size > max(PENDING, 2 * self.kept):
                self.contract()

    def contract(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.a:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        a, b = forest(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b, self.size, self.kept = [a], [b], len(a), len(a)
        return a, b


def match(prints: np.ndarray, key: np.ndarray, found: Found) -> None:
    """Add the verified links within buckets; rows are sorted by key. Large buckets go block by block."""
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edge)
    for s in np.unique(size[size > 1]):
        at = edge[:-1][size == s]
        if s <= 64:  # buckets of this size together, by distance within the bucket
            for part in np.array_split(at, len(at) * s // 100_000 + 1):
                rows = part[:, None] + np.arange(s)
                for d in range(1, s):
                    i, j = rows[:, :-d].ravel(), rows[:, d:].ravel()
                    ok = np.bitwise_count(prints[i] ^ prints[j]) <= LINK
                    found.add(prints[i[ok]], prints[j[ok]])
            continue
        for o in at:
            own = prints[o : o + s]
            for x in range(0, s, BLOCK):
                for y in range(x, s, BLOCK):
                    i, j = np.nonzero(np.bitwise_count(own[x : x + BLOCK, None] ^ own[None, y : y + BLOCK]) <= LINK)
                    ok = x + i < y + j
                    found.add(own[x + i[ok]], own[y + j[ok]])


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) with the components of all pairs of distinct ``fp`` at most LINK bits apart."""

    def emit(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 20_000):
                fp = batch.column(0).slice(i, 20_000).to_numpy(zero_copy_only=False)
                key, row = keys_of(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(fp[row])], ["key", "fp"])

    def meet(batches):
        rest_key, rest, found = np.empty(0, np.int32), np.empty(0, np.uint64), Found()
        for batch in batches:
            key = np.concatenate([rest_key, batch.column(0).to_numpy()])
            fp = np.concatenate([rest, batch.column(1).to_numpy().view(np.uint64)])
            whole = np.searchsorted(key, key[-1]) if len(key) else 0  # the last bucket may go on
            rest_key, rest = key[whole:], fp[whole:]
            match(fp[:whole], key[:whole], found)
        match(rest, rest_key, found)
        a, b = found.contract()
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    keyed = prints.select("fp").mapInArrow(emit, "key int, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); alternating large and small stars."""
    a, b = F.col("a"), F.col("b")
    edges = cut(pairs.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        sums = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first()
        if sums == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = sums
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(both, least, "u", "n", 2 * sums[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut(large)
        lower = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_hot(large, lower, "u", "n", large.count()).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())


def _printed(docs: DataFrame) -> DataFrame:
    return cut(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprints("text").alias("fp")))


def _groups(printed: DataFrame) -> DataFrame:
    """(fp, n, best): each fingerprint's rows and the first row of its component, struct(lost, doc_id, text_hash)."""
    row = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_hash")
    unique = cut(printed.groupBy("fp").agg(F.min(row).alias("own"), F.count(F.lit(1)).alias("n")))
    roots = components(cut(links(unique)))
    # A node's own row belongs to its root's component too, so the roots are members as well.
    member = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    linked = cut(unique.join(member, "fp"))
    best = linked.groupBy("root").agg(F.min("own").alias("best"), F.count(F.lit(1)).alias("members"))
    known = join_hot(linked, best, "root", "members", linked.count()).select("fp", "best")
    return cut(unique.join(known, "fp", "left").select("fp", "n", F.coalesce("best", "own").alias("best")))


def clusters(docs: DataFrame) -> DataFrame:
    """Per document doc_id, fingerprint (16 hex digits) and component_id, the least id of its component."""
    printed = _printed(docs)
    groups = _groups(printed).select("fp", "n", F.col("best.doc_id").alias("component_id"))
    met = join_hot(printed, groups, "fp", "n", printed.count())
    return met.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The first document of each component, with the columns of ``docs``."""
    null, ident, text, rank = (fresh(docs, x) for x in ("lost", "ident", "text", "rank"))
    best = _groups(_printed(docs)).select("best.*").distinct()
    best = best.select(F.col("lost").alias(null), F.coalesce(F.col("doc_id"), F.lit(0)).alias(ident), F.col("text_hash").alias(text))
    keyed = docs.withColumns({null: F.col("doc_id").isNull(), ident: F.coalesce(F.col("doc_id"), F.lit(0)), text: F.xxhash64("text")})
    kept = keyed.join(best, [null, ident, text], "left_semi")
    order = W.partitionBy(null, ident, text).orderBy("text")
    return kept.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
