"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded by its
frequencies of neighbouring character classes and by how far it repeats words. A
hidden layer embeds it, gated attention (tanh times sigmoid) weighs it within its
document, and the score is a logistic function of the weighted embedding. Only the
documents carry labels; the attention is learned with the rest by gradient descent.

Labels come from rows outside the held-out fold, at most ``SAMPLE`` of each class;
neither language, source nor id enters a score. Defined cases: a null or empty text is
one empty passage; a very long text is encoded in parts, with 1 kB of memory for each of
its passages; repeated rows get equal scores; an empty table gives no rows; other columns
are ignored; if either class has no labelled document, every score is the share of good
labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import text_slices

PASSAGE = 64
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, SEED = 25, 64, 3e-3, 20
THRESHOLD = 0.3
#: Bytes of text that are encoded together.
CHUNK = 1 << 20

# Classes of bytes: letters, digits, white space, single marks, and the rest.
_CLASS = np.full(256, 15, np.int64)
for _k, _set in enumerate([b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b" \t\v\f\r", b"\n", b".,;:?", b"!", b"#", b"*$", b"%&", b"|", b"<>=/\\{}[]()_~^@", b"\"'`-+"]):
    _CLASS[list(_set)] = _k
CLASSES = 16
WIDTH = CLASSES * CLASSES + 3
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True


def parts(text: bytes) -> list[bytes]:
    """A text and a closing space; more than CHUNK bytes are cut before words whose number is a multiple of PASSAGE."""
    text += b" "
    if len(text) <= CHUNK:
        return [text]
    space = _SPACE[np.frombuffer(text, np.uint8)]
    cuts = np.flatnonzero(~space & np.r_[True, space[:-1]])[:: PASSAGE * 512][1:].tolist()
    return [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])]


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(passages x WIDTH, document of each passage) of whole texts, some CHUNK bytes at a time."""
    xs, bags, group, size = [], [], [], 0
    todo = [(i, part) for i, t in enumerate(texts) for part in parts(t)]
    for k, (i, part) in enumerate(todo):
        group.append((i, part))
        size += len(part)
        if size > CHUNK or k == len(todo) - 1:
            x, own = _pairs([p for _, p in group])
            xs.append(x)
            bags.append(np.array([i for i, _ in group])[own])
            group, size = [], 0
    x, bag = np.concatenate(xs), np.concatenate(bags)
    row = 0
    for text in texts:
        words, seen = text.split(), set()
        for k in range(0, len(words), PASSAGE):
            part = words[k : k + PASSAGE]
            own = set(part)
            x[row, -3:] = 1 - len(own) / len(part), len(own & seen) / len(own), len(part) / PASSAGE
            seen |= own
            row += 1
        row += not words
    return x, bag


def _pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies of neighbouring character classes of each passage, and its text."""
    size = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    space = _SPACE[flat]
    starts = ~space & np.r_[True, space[:-1]]
    word = np.cumsum(starts, dtype=np.int32)
    first = np.cumsum(size) - size
    base = word[first] - starts[first]  # words before each text
    inside = np.maximum(word - base[doc] - 1, 0) // PASSAGE
    passages = inside[first + size - 1] + 1
    offset = np.cumsum(passages) - passages
    at = offset[doc] + inside
    cls = _CLASS[flat]
    pair = cls[:-1] * CLASSES + cls[1:]
    same = at[:-1] == at[1:]
    n = int(passages.sum())
    counts = np.bincount(at[:-1][same] * (CLASSES * CLASSES) + pair[same], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    x = np.zeros((n, WIDTH), np.float32)
    x[:, :-3] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    return x, np.repeat(np.arange(len(texts)), passages)


def _sums(values: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
    """Sums by bag; the rows of a bag are neighbours."""
    first = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    out[bag[first]] = np.add.reduceat(values, first, axis=0)
    return out


@dataclass
class Model:
    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    prior: float


def start(rng: np.random.Generator, width: int = WIDTH) -> dict[str, np.ndarray]:
    def layer(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    zero = {"b": HIDDEN, "bv": GATE, "bu": GATE, "c0": 1}
    return {"W": layer(width, HIDDEN), "V": layer(HIDDEN, GATE), "U": layer(HIDDEN, GATE), "w": layer(GATE), "c": layer(HIDDEN)} | {k: np.zeros(n, np.float32) for k, n in zero.items()}


def forward(p: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"] + p["bv"]), labelled.sigmoid(h @ p["U"] + p["bu"])
    e = (t * s) @ p["w"]
    e = np.exp(np.clip(e - e.max(initial=0), -60, 0))  # |e| is at most the norm of w, so that one shift serves all bags
    a = e / _sums(e, bag, n)[bag]
    z = _sums(a[:, None] * h, bag, n)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "q": labelled.sigmoid(z @ p["c"] + p["c0"])}


def gradients(p, x, bag, y, weight) -> dict[str, np.ndarray]:
    """Of the weighted mean cross-entropy."""
    n = len(y)
    f = forward(p, x, bag, n)
    do = (weight * (f["q"] - y) / weight.sum()).astype(x.dtype)
    dz = do[:, None] * p["c"]
    dh = f["a"][:, None] * dz[bag]
    da = (f["h"] * dz[bag]).sum(1)
    de = f["a"] * (da - _sums(f["a"] * da, bag, n)[bag])
    dg = de[:, None] * p["w"]
    dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
    dh = (dh + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "bv": dt.sum(0), "U": f["h"].T @ ds, "bu": ds.sum(0), "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ do, "c0": do.sum(keepdims=True)}


def fit(texts: list[str], y: np.ndarray, sizes: tuple[int, int]) -> Model:
    total = sum(sizes)
    prior = sizes[1] / total if total else 0.0
    if not (y == 0).any() or not (y == 1).any():
        return Model({}, np.zeros(0), np.zeros(0), prior)
    x, bag = encode([t.encode("utf-8", "replace") for t in texts])
    mean, scale = x.mean(0), x.std(0) + 1e-2
    x = (x - mean) / scale
    edge = np.searchsorted(bag, np.arange(len(y) + 1))
    rng = np.random.default_rng(SEED)
    p, weight = start(rng), labelled.class_weights(y, sizes)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            docs = np.sort(order[i : i + BATCH])
            rows = np.concatenate([np.arange(edge[d], edge[d + 1]) for d in docs])
            own = np.repeat(np.arange(len(docs)), edge[docs + 1] - edge[docs])
            step += 1
            for k, g in gradients(p, x[rows], own, y[docs], weight[docs]).items():
                g = g + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = (p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(p, mean, scale, prior)


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    if not model.p or not texts:
        return np.full(len(texts), model.prior)
    x, bag = encode(texts)
    return forward(model.p, (x - model.mean) / model.scale, bag, len(texts))["q"].astype(float)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document doc_id, held_out, score and predicted."""
    model = labelled.fitted(docs, labels, "quality", fit)

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, limit=4 << 20):
                texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores(texts, model))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), labelled.held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
