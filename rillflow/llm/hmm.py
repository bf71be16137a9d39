"""A hidden Markov language model over words.

Every word belongs to one class: words of at least ``least`` training tokens have one
each, however many they are; the others share the class of their last two letters, and
all unseen words are one more type. A word's probability in a state is the state's
emission of its class times the word's share of its class in the smoothed unigram, so
that every state is a proper distribution. ``least`` is a count and does not follow the
size of the corpus: more text gives more words an emission of their own. The driver and
each task hold ``STATES`` numbers of 8 bytes for each of them; raise ``least`` where
that is too much.
Baum-Welch: each task runs the scaled forward and backward recursions over its
sequences and adds up expected starts, transitions and emissions; Spark sums these
tables, which have a row for each class and so grow with the vocabulary, and the next
round starts from them. The scaled forward recursion then gives the exact likelihood of each text.

Counts come from all training documents. The texts are read once, into blocks of
sequences of block-local word numbers; the vocabulary, which grows with the corpus, is
counted by a shuffle and goes back to the blocks by another. A word is one row for each
block there, so that its group grows with the blocks (16 MB of text each), not with its
occurrences; the window over it spills.

Defined cases: a null or empty text is its end token alone; a very long text is a block
of its own and one sequence, of 4 bytes a token; a null ``doc_id`` is held out; repeated
rows are scored, and counted, each; with no training documents every token has
probability one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_bucket, discard, text_slices, written

FOLDS, ADD = 10, 0.1
STATES, ROUNDS, SEED = 6, 4, 4
#: Words of at least so many training tokens are classes of their own.
LEAST = 100
#: Up to this many words with an emission of their own are broadcast when they are numbered; beyond, they are joined by shuffle.
BROADCAST_WORDS = 1_000_000
#: A word longer than this many bytes goes by its 128-bit digest.
LONG_WORD = 32
UNSEEN, LETTERS = 0, 27
FIRST_OWN = 1 + LETTERS * LETTERS
BLOCK_BYTES = 16 << 20
#: Tokens of the sequences that one recursion advances together.
TOKENS = 150_000

#: Expected counts cross the network in single precision, in records of this many classes.
COUNT, CHUNK = np.float32, 4096

_LETTER = np.full(256, 26, np.int16)
_LETTER[ord("a") : ord("z") + 1] = np.arange(26)


def suffixes(words: list[bytes]) -> np.ndarray:
    """The class of each word's last two bytes; other bytes than letters are one."""
    size = np.array([len(w) for w in words])
    end = np.cumsum(size)
    flat = np.append(np.frombuffer(b"".join(words), np.uint8), np.uint8(0))
    last = np.where(size > 0, _LETTER[flat[np.maximum(end - 1, 0)]], 26)
    before = np.where(size > 1, _LETTER[flat[np.maximum(end - 2, 0)]], 26)
    return (1 + before * LETTERS + last).astype(np.int16)


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of kind 0: a document's words as block-local numbers; of kind 1: a block's words with their training counts."""

    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in text_slices(whole, limit=BLOCK_BYTES):
                index: dict[bytes, int] = {b"": 0}  # the end token
                ids = [np.array([index.setdefault(w, len(index)) for w in (x or b"").lower().split()] + [0], np.int32) for x in batch.column("text").cast(pa.binary()).to_pylist()]
                held = batch.column("held_out").to_pylist()
                n = np.bincount(np.concatenate([x for x, h in zip(ids, held) if not h] or [np.empty(0, np.int32)]), minlength=len(index))
                words = list(index)
                block = (task << 24) | k
                k += 1

                def rows(kind, size, **columns):
                    given = {"block": pa.array(np.full(size, block), pa.int64()), "kind": pa.array(np.full(size, kind), pa.int32())} | columns
                    return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema)

                yield rows(0, len(ids), doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), ids=pa.array([x.tobytes() for x in ids], pa.binary()))
                yield rows(1, len(words), word=pa.array([w if len(w) <= LONG_WORD else b"\n" + xxhash.xxh3_128_digest(w) for w in words], pa.binary()), n=pa.array(n, pa.int64()), number=pa.array(np.arange(len(words)), pa.int32()), suffix=pa.array(suffixes(words)))

    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("word", pa.binary()), ("n", pa.int64()), ("number", pa.int32()), ("suffix", pa.int16())])
    rows = docs.select(F.col("doc_id").cast("long"), (crc_bucket(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "block long, kind int, doc_id long, held_out boolean, ids binary, word binary, n long, number int, suffix short")


def counted(vocabulary: DataFrame, least: int = LEAST) -> DataFrame:
    """(block, number, c, suffix, first, word): the words' training counts over the corpus; ``word`` only of frequent ones."""
    group = W.partitionBy("word")
    rows = vocabulary.select("block", "number", "suffix", "word", F.sum("n").over(group).alias("c"), (F.max("block").over(group) == F.col("block")).alias("first"))
    return rows.withColumn("word", F.when(F.col("c") >= least, F.col("word")))


class Unigram:
    """The smoothed unigram: totals, and the mass of each class (class 0 is the unseen type)."""

    def __init__(self, tokens: int, types: int, sums: dict[int, tuple[int, int]], classes: int):
        self.tokens, self.types = tokens, types
        self.floor = tokens + ADD * (types + 1)
        self.mass = np.zeros(classes)
        for k, (c, n) in sums.items():
            self.mass[k] = (c + ADD * n) / self.floor
        self.mass[UNSEEN] = ADD / self.floor

    def word(self, c: np.ndarray) -> np.ndarray:
        return (c + ADD) / self.floor


def sequences(docs: DataFrame, words: DataFrame, unigram: Unigram) -> DataFrame:
    """Per document its token counts, base score, share of the words within their classes, and class sequence."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        number = right.column("number").to_numpy()
        c, cls = np.zeros(len(number)), np.zeros(len(number), np.uint32)
        c[number] = right.column("c").to_numpy()
        cls[number] = right.column("cls").to_numpy()
        p = unigram.word(c)
        base, share = np.log10(p), np.log10(p / np.where(unigram.mass[cls] > 0, unigram.mass[cls], 1))
        ids = [np.frombuffer(x, np.int32) for x in left.column("ids").to_pylist()]
        return pa.Table.from_arrays(
            [
                left.column("doc_id"),
                left.column("held_out"),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([int((c[x] > 0).sum()) for x in ids], pa.int64()),
                pa.array([float(base[x].sum()) for x in ids], pa.float64()),
                pa.array([float(share[x].sum()) for x in ids], pa.float64()),
                pa.array([cls[x].tobytes() for x in ids], pa.binary()),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "share", "classes"],
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, share double, classes binary"
    return docs.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(meet, schema)


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # K; K x K; K x classes
        self.by_class = np.ascontiguousarray(emit.T)

    @classmethod
    def initial(cls, unigram: Unigram, states: int = STATES, seed: int = SEED) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = unigram.mass * np.exp(rng.standard_normal((states, len(unigram.mass))))
        emit[:, UNSEEN] = 0
        emit *= (1 - unigram.mass[UNSEEN]) / np.maximum(emit.sum(1, keepdims=True), 1e-300)
        emit[:, UNSEEN] = unigram.mass[UNSEEN]
        off = 0.02 / max(1, states - 1)
        return cls(np.full(states, 1 / states), np.full((states, states), off) + np.eye(states) * (0.98 - off), emit)

    def batches(self, sequences: list[np.ndarray]):
        """Index lists of sequences of similar length, of TOKENS together (or one sequence)."""
        order, group, total = sorted(range(len(sequences)), key=lambda i: -len(sequences[i])), [], 0
        for i in order:
            if group and total + len(sequences[i]) > TOKENS:
                yield group
                group, total = [], 0
            group.append(i)
            total += len(sequences[i])
        if group:
            yield group

    def forward(self, seqs: list[np.ndarray]):
        """Time-major layout of sequences in descending length: (offsets, active counts, classes, emissions, alpha, scale)."""
        size = np.array([len(s) for s in seqs])
        active = np.searchsorted(-size, -np.arange(size[0]), "left")  # sequences longer than t
        offset = np.r_[0, np.cumsum(active)]
        cls = np.empty(offset[-1], np.int64)
        for j, s in enumerate(seqs):
            cls[offset[: len(s)] + j] = s
        b = self.by_class[cls]
        alpha, scale = np.empty_like(b), np.empty(len(b))
        for t, n in enumerate(active):
            o = offset[t]
            a = (self.start if t == 0 else alpha[offset[t - 1] : offset[t - 1] + n] @ self.move) * b[o : o + n]
            s = a.sum(1)
            np.divide(a, s[:, None], out=alpha[o : o + n])
            scale[o : o + n] = s
        return offset, active, cls, b, alpha, scale

    def score(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 likelihood of each sequence of classes."""
        out = np.zeros(len(sequences))
        for group in self.batches(sequences):
            offset, active, _, _, _, scale = self.forward([sequences[i] for i in group])
            log, sums = np.log10(scale), np.zeros(len(group))
            for t, n in enumerate(active):
                sums[:n] += log[offset[t] : offset[t] + n]
            out[group] = sums
        return out

    def expect(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, transitions and emissions (classes x K)."""
        k, m = self.emit.shape
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((m, k))
        for group in self.batches(sequences):
            offset, active, cls, b, alpha, scale = self.forward([sequences[i] for i in group])
            beta = np.ones_like(alpha)
            out = b / scale[:, None]  # becomes emission times beta over scale
            for t in range(len(active) - 1, 0, -1):
                n, o, p = active[t], offset[t], offset[t - 1]
                out[o : o + n] *= beta[o : o + n]
                beta[p : p + n] = out[o : o + n] @ self.move.T
            gamma = alpha * beta
            start += gamma[: active[0]].sum(0)
            later = np.arange(active[0], len(cls))
            step = np.repeat(active[:-1], active[1:]) if len(active) > 1 else later
            move += self.move * (alpha[later - step].T @ out[later])
            for j in range(k):
                emit[:, j] += np.bincount(cls, weights=gamma[:, j], minlength=m)
        return start, move, emit

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: Unigram) -> Hmm:
        """Maximisation, with the unigram as a prior of 100 tokens for each state."""
        prior = unigram.mass * 100
        emit = emit.T + prior
        emit[:, UNSEEN] = 0
        emit *= (1 - unigram.mass[UNSEEN]) / np.maximum(emit.sum(1, keepdims=True), 1e-300)
        emit[:, UNSEEN] = unigram.mass[UNSEEN]
        start, move = start + 1, move + 1
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit)


def decoded(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) for x in batch.column("classes").to_pylist()]


def packed(table: np.ndarray) -> pa.RecordBatch:
    """The non-zero rows of a table of expected counts, as a record for each ``CHUNK`` rows."""
    used = np.flatnonzero(table.any(1))
    edge = np.searchsorted(used, np.arange(0, len(table) + CHUNK, CHUNK))
    parts = [(k, used[i:j]) for k, (i, j) in enumerate(zip(edge, edge[1:])) if i < j]
    places = [(at - k * CHUNK).astype(np.uint16).tobytes() for k, at in parts]
    values = [table[at].astype(COUNT).tobytes() for _, at in parts]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["chunk", "places", "counts"])


def summed(batches, states: int):
    """The records of each chunk added up, in double precision; a task holds the sums of its chunks only."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, places, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own = total.setdefault(chunk, np.zeros((CHUNK, states)))
            own[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, COUNT).reshape(-1, states)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])


def train(rows: DataFrame, unigram: Unigram, rounds: int = ROUNDS) -> Hmm:
    model, k = Hmm.initial(unigram), STATES

    for _ in range(rounds):

        def count(batches, model=model):
            total = None
            for batch in batches:
                own = model.expect(decoded(batch))
                total = own if total is None else tuple(a + b for a, b in zip(total, own))
            if total is not None:
                yield packed(np.concatenate([total[0][None], total[1], total[2]]))

        stats = rows.where(~F.col("held_out")).select("classes").mapInArrow(count, "chunk int, places binary, counts binary")
        sums = stats.repartition("chunk").mapInArrow(lambda batches: summed(batches, k), "chunk int, counts binary").collect()  # K numbers for each class
        table = np.zeros((-(-(1 + k + len(unigram.mass)) // CHUNK) * CHUNK, k))
        for r in sums:
            table[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts).reshape(CHUNK, k)
        model = Hmm.from_counts(table[0], table[1 : 1 + k], table[1 + k : 1 + k + len(unigram.mass)], unigram)
    return model


def score(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per document doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    least: training tokens from which a word has an emission of its own.
    """
    spark = docs.sparkSession
    both, raw = written(blocks(docs))
    vocabulary = both.where("kind = 1")
    tokens = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words, looked = written(counted(vocabulary, least))
    own = words.where("first AND word IS NOT NULL").select("word").toArrow().sort_by("word")
    named = spark.createDataFrame(own.append_column("own", pa.array(np.arange(len(own)) + FIRST_OWN, pa.int32())), "word binary, own int")
    if len(own) <= BROADCAST_WORDS:
        words = words.join(F.broadcast(named), "word", "left")
    else:  # rare words have no ``word`` and stay out of the shuffle
        words = words.where("word IS NOT NULL").join(named, "word").unionByName(words.where("word IS NULL").withColumn("own", F.lit(None).cast("int")))
    words = words.withColumn("cls", F.when(F.col("c") == 0, UNSEEN).otherwise(F.coalesce("own", F.col("suffix").cast("int"))))
    sums = words.where("first AND c > 0").groupBy("cls").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toArrow()
    cls, c, n = (sums.column(x).to_pylist() for x in ("cls", "c", "n"))
    unigram = Unigram(tokens, sum(n), dict(zip(cls, zip(c, n))), FIRST_OWN + len(own))
    rows, _ = written(sequences(both.where("kind = 0").select("block", "doc_id", "held_out", "ids"), words.select("block", "number", "c", "cls"), unigram))
    discard(spark, raw)
    discard(spark, looked)
    model = train(rows, unigram)

    def run(batches):
        for batch in batches:
            scores = model.score(decoded(batch)) + batch.column("share").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores)], [*kept, "score"])

    kept = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    out = rows.select(*kept, "share", "classes").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
