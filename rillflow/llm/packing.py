"""Best-fit packing of token sequences.

Bulk-synchronous best-fit decreasing, in supersteps over bands of lengths, long ones
first (``bands``). A superstep range-sorts the band's
documents and the open gaps by size, ties split by their id. Every task sweeps its
range: a document takes its successor, the smallest gap left that holds it, which is
the bracket matching of gaps and documents in descending order; of documents that meet
at one gap the rank decides. What stays open in a range goes by rank to the gaps left
over in the ranges of larger sizes: tasks report two counts each, the driver matches
these (two numbers for each task, whatever the input), and the rows meet in a join. Then
the gaps are updated and the next superstep follows; ``SWEEPS`` of them a band, in the
first of which a wide gap takes several documents at a time. Documents that no gap holds
open new sequences, as many to one as surely fit.

Documents longer than ``CAPACITY`` are cut into full pieces, the first piece takes the
rest. Ids are those of the tokenizers library. They come from tiktoken on the same
vocabulary, which is quicker and equal in tests; texts that its bounded regex stack does
not take go to the own encoder of ``bpe``.

Defined cases: a null or empty text is one closing token; a very long text is encoded
whole, in one task; of equal lengths any may come first; repeated rows are packed each;
an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, text_slices

CAPACITY = 2048
END = 0  # the token that closes a document
#: Supersteps in a band of lengths at most.
SWEEPS = 2
#: Rows of a range that one task sweeps.
RANGE = 2_000_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, id long"
_NAMES = [x.split()[0] for x in PIECE.split(", ")]
_ARROW = pa.schema(list(zip(_NAMES, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()])))


def encoder(path: str):
    """The ids of a text as the tokenizers library gives them, from a byte-level BPE file."""
    import tiktoken

    from .bpe import PATTERN, Bpe, load

    bpe: Bpe = load(path)
    ranks = {bpe.bytes[s : s + n].tobytes(): i for i, (s, n) in enumerate(zip(bpe.start, bpe.length)) if n and i not in bpe.special.values()}
    fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=bpe.special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its regex stack is bounded: white space of about a million characters in one run
            return bpe.encode_batch([text])[0]

    return encode


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece doc_id, piece, start, length, ids_crc32, and an id of its own (task and place)."""

    def run(batches):
        encode, own = encoder(vocabulary), TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in text_slices(whole):
                out: list[tuple] = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    ids = np.append(encode(text or ""), END).astype("<u4")
                    at = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (i, j) in enumerate(zip(at, at[1:])):
                        out.append((doc_id, k, i, j - i, zlib.crc32(ids[i:j].tobytes()), own))
                        own += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _ARROW.types)] if out else [pa.array([], t) for t in _ARROW.types], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


def bands(capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(low, high] of the bands of lengths: three halvings, in which a gap takes few documents, then quarters."""
    edges = [capacity, capacity // 2, capacity // 4, capacity // 8, capacity // 32, 0]
    return [(low, high) for high, low in zip(edges, edges[1:]) if low < high]


def brackets(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (gap, document) that match: each document (False) takes the nearest gap (True) before it that is still free."""
    step = np.where(opens, 1, -1)
    depth = np.cumsum(step)
    level = np.where(opens, depth, depth + 1)  # a pair opens and closes on one level
    order = np.argsort(level, kind="stable")
    first, second = order[:-1], order[1:]
    ok = (level[first] == level[second]) & opens[first] & ~opens[second]
    return first[ok], second[ok]


def across(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Matches between ranges with (documents, gaps) left, in descending order of size.

    Rows (range of the documents, first of them, range of the gaps, last of them, number);
    documents count upwards, the gaps, smallest first, downwards.
    """
    free: list[list[int]] = []  # (range, gaps left in it), the smallest last
    out = []
    for k, (documents, gaps) in enumerate(ranges):
        at = 0
        while free and at < documents:
            n = min(documents - at, free[-1][1])
            out.append((k, at, free[-1][0], free[-1][1] - 1, n))
            at += n
            free[-1][1] -= n
            if not free[-1][1]:
                free.pop()
        if gaps:
            free.append([k, gaps])
    return np.array(out, np.int64).reshape(-1, 5)


def swept(docs: DataFrame, gaps: DataFrame, low: int, high: int, ranges: int) -> DataFrame:
    """Range-sorted documents and the slots of gaps, with what each range matches in itself.

    Rows with ``length`` and ``sequence_id`` are placed; others have their range and rank
    (of the documents or of the slots left in it).
    """
    many = F.greatest(F.lit(1), F.expr(f"room div {high}"))
    slots = gaps.select("sequence_id", "room", F.explode(F.sequence(F.lit(1).cast("long"), many)).alias("slot"))
    slots = slots.select((F.col("room").cast("double") / many).alias("size"), "sequence_id", "room", "slot", *[F.lit(None).cast(t).alias(c) for c, t in zip(_NAMES, ("long", "int", "long", "long", "long", "long"))])
    wanted = docs.select(F.col("length").cast("double").alias("size"), *[F.lit(None).cast("long").alias(c) for c in ("sequence_id", "room", "slot")], *_NAMES)
    both = slots.unionByName(wanted)
    keys = [F.col("size").desc(), F.col("id").isNotNull(), F.xxhash64("sequence_id", "slot", "id")]
    both = both.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("size", "slot")

    def sweep(batches):
        table = pa.Table.from_batches(batches)
        if not len(table):
            return
        opens = table.column("id").is_null().to_numpy()
        gap, doc = brackets(opens)
        pairs = table.take(pa.array(doc))
        pairs = pairs.set_column(0, "sequence_id", table.column("sequence_id").take(pa.array(gap))).set_column(1, "room", table.column("room").take(pa.array(gap)))
        left = np.ones(len(opens), bool)
        left[gap] = left[doc] = False
        at = np.flatnonzero(left)
        rank = np.where(opens[at], np.cumsum(opens[at]), np.cumsum(~opens[at])) - 1
        part = TaskContext.get().partitionId()
        for t, where, ranks in ((pairs, None, None), (table.take(pa.array(at)), part, rank)):
            n = len(t)
            t = t.append_column("range", pa.nulls(n, pa.int32()) if where is None else pa.array(np.full(n, where, np.int32)))
            t = t.append_column("rank", pa.nulls(n, pa.int64()) if ranks is None else pa.array(ranks, pa.int64()))
            yield from t.to_batches()

    return cut(both.mapInArrow(sweep, f"sequence_id long, room long, {PIECE}, range int, rank long"))


def mates(runs: np.ndarray, of_gaps: bool):
    """A column function (range, rank) that numbers the matches of :func:`across`; null without a match."""
    base = np.cumsum(runs[:, 4]) - runs[:, 4]
    part, start = (runs[:, 2], runs[:, 3] - runs[:, 4] + 1) if of_gaps else (runs[:, 0], runs[:, 1])
    order = np.argsort(part * (1 << 40) + start)
    key, size, base = (part * (1 << 40) + start)[order], runs[order, 4], base[order]

    @F.arrow_udf("long")
    def number(where: pa.Array, rank: pa.Array) -> pa.Array:
        want = where.to_numpy(zero_copy_only=False).astype(np.int64) * (1 << 40) + rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(key, want, "right") - 1
        into = want - key[np.maximum(at, 0)]
        ok = (at >= 0) & (into < size[at])
        return pa.array(base[at] + (size[at] - 1 - into if of_gaps else into), pa.int64(), mask=~ok)

    return number


def superstep(docs: DataFrame, gaps: DataFrame, low: int, high: int, ranges: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(placed pieces with sequence_id, documents left, gaps, number of documents placed)."""
    rows = swept(docs, gaps.where(F.col("room") > low), low, high, ranges)
    inside, free, wanting = rows.where("range IS NULL"), rows.where("range IS NOT NULL AND id IS NULL"), rows.where("range IS NOT NULL AND id IS NOT NULL")
    counts = rows.groupBy("range").agg(F.count("id").alias("d"), F.count(F.when(F.col("id").isNull(), 1)).alias("g")).collect()  # one row for each range
    left = {r["range"]: (r.d, r.g) for r in counts if r["range"] is not None}
    done = sum(r.d for r in counts if r["range"] is None)
    runs = across([left.get(k, (0, 0)) for k in range(max(left, default=-1) + 1)])
    placed = inside.select(*_NAMES, "sequence_id", "room")
    if len(runs):
        free = free.withColumn("mate", mates(runs, True)("range", "rank"))
        wanting = wanting.withColumn("mate", mates(runs, False)("range", "rank"))
        met = wanting.where("mate IS NOT NULL").select(*_NAMES, "mate").join(free.where("mate IS NOT NULL").select("sequence_id", "room", "mate"), "mate")
        placed = placed.unionByName(met.drop("mate"))
        free, wanting = free.where("mate IS NULL"), wanting.where("mate IS NULL")
    used = placed.select("sequence_id", "room", "length").unionByName(free.select("sequence_id", "room", F.lit(0).cast("long").alias("length")))
    used = used.groupBy("sequence_id").agg((F.max("room") - F.sum("length")).alias("room"))
    gaps = cut(gaps.where(F.col("room") <= low).unionByName(used.where("room > 0")))
    return placed.drop("room"), wanting.select(*_NAMES), gaps, done + int(runs[:, 4].sum())


def opened(docs: DataFrame, together: int) -> DataFrame:
    """New sequences of up to ``together`` documents that stand together in a task, named after the first.

    ``docs`` are rows of a checkpoint, so that their order in a task stays.
    """

    def name(batches):
        leader, n = None, 0
        for batch in batches:
            ids, names = batch.column("id").to_pylist(), []
            for i in ids:
                if n % together == 0:
                    leader = i
                n += 1
                names.append(leader)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], [*_NAMES, "sequence_id"])

    return docs.select(*_NAMES).mapInArrow(name, PIECE + ", sequence_id long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset."""
    every = cut(pieces(docs, vocabulary, capacity))
    totals = {r.length: r.n for r in every.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    least = docs.sparkSession.sparkContext.defaultParallelism
    gaps, open_, parts = every.limit(0).select(F.col("id").alias("sequence_id"), F.col("length").alias("room")), 0, []
    for low, high in bands(capacity):
        left = sum(n for x, n in totals.items() if low < x <= high)
        band = every.where((F.col("length") > low) & (F.col("length") <= high))
        # No gap of the first bands takes two documents of the next one.
        for _ in range((SWEEPS if 4 * high <= capacity else 1) if open_ and left else 0):
            # A gap offers at most capacity // high slots; those of a range and the documents are swept together.
            ranges = max(least, (left + open_ * max(1, capacity // high)) // RANGE)
            placed, band, gaps, n = superstep(band, gaps, low, high, ranges)
            parts.append(placed)
            left -= n
            if not left or not n:
                break
        if left:
            new = opened(band, capacity // high)
            parts.append(new)
            rooms = new.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room")).where("room > 0")
            gaps = cut(gaps.unionByName(rooms))
            open_ += left
    if not parts:
        parts = [every.withColumn("sequence_id", F.col("id"))]
    placed = parts[0]
    for x in parts[1:]:
        placed = placed.unionByName(x)
    before = W.partitionBy("sequence_id").orderBy(F.col("length").desc(), "id").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", offset)
