"""Bounded samples of labelled documents, and logistic calibration on them."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket

#: Documents with this remainder of crc32(doc_id) modulo FOLDS are held out.
FOLDS, HELD_OUT = 5, 0
#: Bound on the labelled documents of each class that a classifier is fitted on.
SAMPLE = 3000


def held_out(doc_id):
    return crc_bucket(doc_id, FOLDS) == HELD_OUT


def fitted(docs: DataFrame, labels: DataFrame, label: str, fit: Callable, bound: int = SAMPLE):
    """``fit(texts, y, sizes)`` on a sample of the rows outside the held-out fold, in one task.

    y are labels 0 and 1, sizes the labelled documents of each class. The sample holds
    at most ``bound`` documents of each class, those with the least hash of their id.
    Null labels and ids are ignored; of contradicting labels the larger counts; of rows
    that share an id the text that sorts first is taken.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    found = {r.y: r.n for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = found.get(0, 0), found.get(1, 0)
    picked = [marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * bound rows
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches):
        taken = [(i, y, x or "") for b in batches for i, y, x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "y", "text")))]
        taken.sort(key=lambda r: r[0])
        model = fit([r[2] for r in taken], np.array([r[1] for r in taken], np.int64), sizes)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = rows.select("doc_id", "y", "text").repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(made.model)) if made else fit([], np.zeros(0, np.int64), sizes)


def class_weights(y: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
    """Weights that give the sample the class shares of all labelled rows; they sum to the sample's size."""
    have = np.bincount(y, minlength=2)
    w = np.array(sizes, float) / np.maximum(have, 1)
    return w[y] * len(y) / max(1.0, (w * have).sum())


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients, the intercept last, of a ridge logistic regression by Newton's method."""
    a = np.c_[x, np.ones(len(x))]
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    beta = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (w * (y - p)) - penalty * beta
        hessian = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
