"""Toxicity by compression distance.

Two zstandard dictionaries: the ordinary one is trained by zstandard on windows of
ordinary text, the toxic one extends it by what only toxic text repeats, so that both
compress ordinary windows alike and a window's difference in compressed length tells
of toxic content. A window is one word, three times over: shorter input is left raw by
the coder, and longer windows add matches of ordinary text. Thresholds on the
difference, counted over all windows of the text, are calibrated to a probability on
labelled documents that did not train the dictionaries.

This departs from two dictionaries trained by zstandard and windows of running text,
which did not find toxic documents that are ordinary but for a few words (README).
Toxic training text is mostly ordinary. Its contrast is the words whose different
surroundings (copies of a document share theirs) lie in toxic text so much more often
than the classes' shares explain that chance is ruled out at ``CHANCE``, over all words.

Labels come from rows outside the held-out fold, at most ``labelled.SAMPLE`` of each
class; neither language, source nor id enters a score. Defined cases: a null or empty
text has no window and gets the score of a text without signs; a very long text is
scored whole, each distinct word once; repeated rows get equal scores; an empty table
gives no rows; other columns are ignored; if either class has no labelled document,
every score is the share of toxic labels.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import text_slices

CHANCE = 0.01
#: Lengths in bytes of beginnings that inflected or compound words share.
BEGINNINGS = (4, 5, 6, 7)
ORDINARY_BYTES, LEVEL, REPEATS = 8192, 6, 3
#: Differences in bytes whose counts are the features, beside the largest difference.
THRESHOLDS = (2, 3, 4, 5, 6)
EDGE = b".,;:!?#$%&*\"'()[]|<>-"


def words_of(text: bytes) -> list[bytes]:
    return [w.strip(EDGE) for w in text.lower().split()]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    beta: tuple[float, ...]  # of features(), the intercept last
    prior: float


@lru_cache(maxsize=4)
def coders(ordinary: bytes, toxic: bytes):
    """The compressors with the ordinary dictionary alone and with the toxic one."""

    def coder(content: bytes):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=128, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress

    return coder(ordinary), coder(ordinary + toxic)


def gains(words: set[bytes], ordinary: bytes, toxic: bytes) -> dict[bytes, int]:
    """Bytes that the toxic dictionary saves on the window of each word."""
    plain, other = coders(ordinary, toxic)
    return {w: len(plain(x)) - len(other(x)) for w in words for x in ((b" " + w) * REPEATS + b" ",)}


def features(texts: list[bytes], ordinary: bytes, toxic: bytes) -> np.ndarray:
    """Per text the largest gain and the counts (log) of windows at each threshold; each distinct window is compressed once."""
    split = [words_of(t) for t in texts]
    gain = gains(set().union(*split), ordinary, toxic)
    signs = {w: g for w, g in gain.items() if g >= THRESHOLDS[0]}
    out = np.zeros((len(texts), 1 + len(THRESHOLDS)))
    for row, words in zip(out, split):
        found = [signs[w] for w in words if w in signs]
        if found:
            g = np.array(found)
            row[0] = g.max()
            row[1:] = [np.log1p((g >= t).sum()) for t in THRESHOLDS]
    return out


def trained(size: int, samples: list[bytes]) -> bytes:
    """Content of a dictionary trained on the samples; few samples are taken as they are."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def surroundings(texts: list[list[bytes]]) -> Counter:
    """In how many different surroundings (the words before and after) each word stands."""
    index: dict[bytes, int] = {b"": 0}
    ids = [np.array([0, *(index.setdefault(w, len(index)) for w in words), 0], np.uint64) for words in texts]
    found = [np.empty(0, np.uint64)]
    for x in ids:  # 24 bits of the word and 40 of a hash of its neighbours
        around = x[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ x[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
        found.append(np.unique(x[1:-1] << np.uint64(40) | around >> np.uint64(24)))
    counts = np.bincount((np.unique(np.concatenate(found)) >> np.uint64(40)).astype(np.int64), minlength=len(index))
    return Counter({w: int(counts[i]) for w, i in index.items() if i and counts[i]})


def contrast(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """What only the toxic texts repeat, words and beginnings of words, the most widespread last."""
    here, there = surroundings(toxic), surroundings(ordinary)
    share = here.total() / max(1, here.total() + there.total())
    for counts in (here, there):
        starts: Counter = Counter()
        for w, k in counts.items():
            for n in BEGINNINGS:
                if n < len(w):
                    starts[w[:n]] += k
        counts.update(starts)
    limit = math.log(CHANCE / max(1, len(here)))

    def chance(k: int, n: int) -> float:
        """Logarithm of P(Bin(n, share) >= k), an upper bound (Chernoff)."""
        p = k / n
        rest = (1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0
        return -n * (p * math.log(p / share) + rest) if p > share else 0.0

    found = {w for w, k in here.items() if k > 9 * there[w] and share < 1 and chance(k, k + there[w]) <= limit}
    within = set()  # words that a beginning in the dictionary covers in part: far from the end, where matches cost more
    for w in sorted(found, key=lambda w: (-len(w), w)):
        for n in reversed(BEGINNINGS):
            if n < len(w) and w[:n] in found:
                if here[w[:n]] > 1.5 * here[w]:
                    within.add(w)
                else:
                    found.discard(w[:n])
    return sorted(found, key=lambda w: (w not in within, here[w], w))


def fit(texts: list[str], y: np.ndarray, sizes: tuple[int, int]) -> Model:
    total = sum(sizes)
    prior = sizes[1] / total if total else 0.0
    if not (y == 0).any() or not (y == 1).any():
        return Model(b"", b"", (), prior)
    raw = [t.encode("utf-8", "replace") for t in texts]
    words = [words_of(t) for t in raw]
    teach = np.arange(len(raw)) % 3 != 0  # two thirds train the dictionaries, the rest calibrate
    if not teach.any() or teach.all() or len(set(y[~teach])) < 2 or len(set(y[teach])) < 2:
        teach[:] = True
    picked = [words[i] for i in np.flatnonzero(teach & (y == 0))]
    ordinary = trained(ORDINARY_BYTES, [b" ".join(w[i : i + 12]) + b" " for w in picked for i in range(0, len(w), 12)])
    only = contrast([words[i] for i in np.flatnonzero(teach & (y == 1))], picked)
    toxic = b" " + b" ".join(only) + b" "  # all of them; the bounded sample bounds their number
    rest = ~teach if not teach.all() else teach
    x = features([raw[i] for i in np.flatnonzero(rest)], ordinary, toxic)
    beta = labelled.logistic(x, y[rest], labelled.class_weights(y[rest], sizes), ridge=0.1)
    return Model(ordinary, toxic, tuple(beta), prior)


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    if not model.beta:
        return np.full(len(texts), model.prior)
    return labelled.sigmoid(np.c_[features(texts, model.ordinary, model.toxic), np.ones(len(texts))] @ np.array(model.beta))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document doc_id, held_out, score and predicted."""
    model = labelled.fitted(docs, labels, "toxic", fit)

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole):
                texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores(texts, model))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), labelled.held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
