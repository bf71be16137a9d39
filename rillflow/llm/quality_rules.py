"""Quality rules whose cutoffs are certified on labelled holdouts.

Each rule is a ratio that junk drives up. A ladder sets all cutoffs at a time, from
lenient to strict. For every stratum (language) and rung the labelled good documents
are a holdout: with ``k`` of ``n`` rejected, the rung is certified when the exact
binomial upper bound of its false rejection rate is at most ``ALPHA``, that is when
P(Bin(n, ALPHA) <= k) <= ``DELTA`` / (strata x rungs), a Bonferroni correction over
every test made. Of the certified rungs the one that rejects most labelled junk is
taken (the most lenient of equals). With probability 1 - ``DELTA`` no stratum then
loses more than ``ALPHA`` of its good documents; a stratum with too few labels
certifies nothing and the rules reject nothing there.

Defined cases: a null or empty text has no words and fails the base rules; a very long
text is measured whole; repeated rows are judged each; an empty table gives no rows;
other columns are carried along by :func:`keep_good`, whatever their names; a null
language is a stratum of its own; a document labelled twice counts as good only if all its labels
say so; null labels are ignored; with no labels at all only the base rules act.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh

SYMBOLS = b"#*$%&|<>"
#: False rejections allowed in a stratum, and the chance that any stratum exceeds it.
ALPHA, DELTA = 0.05, 0.05
#: Rules by rung, lenient to strict; a ratio above its cutoff rejects.
LADDER = {
    "symbols": (0.60, 0.45, 0.30, 0.20, 0.12, 0.08, 0.05, 0.03),  # symbols / word characters
    "dup_lines": (0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30, 0.20),  # repeated lines / lines with a word
    "repeats": (0.48, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15),  # words in repeated windows / words
    "capitals": (0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30, 0.20),  # A-Z / word characters
    "shouts": (0.90, 0.80, 0.70, 0.60, 0.45, 0.30, 0.15, 0.05),  # exclamation marks / words
    "cells": (0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.10),  # words that are a bar / words
}
RUNGS = len(LADDER["symbols"])
#: Up to this many strata the table of chosen rungs is broadcast; beyond, it is joined by shuffle.
BROADCAST_STRATA = 10_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts", "n_cells"]
_CONTINUED = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\v\f\r"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def measure(text: bytes) -> tuple[int, ...]:
    """``COUNTS`` of one whole text in UTF-8."""
    words = text.split()  # bytes split at exactly the six ASCII spaces
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    seen: dict[tuple, int] = {}
    first = [seen.setdefault(x, i) for i, x in enumerate(windows)]
    if len(seen) < len(windows):
        twice = {i for k, i in enumerate(first) if i != k}
        end = 0  # words before it are counted
        for k, i in enumerate(first):
            if i in twice:
                repeated += k + 3 - max(k, end)
                end = k + 3
    return (
        len(words),
        len(text.translate(None, _SPACE + _CONTINUED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(text) - len(text.translate(None, _CAPITALS)),
        text.count(b"!"),
        words.count(b"|"),
    )


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS]))
def measures(text: pa.Array) -> pa.Array:
    parts = (text.slice(i, 200).cast(pa.binary()).to_pylist() for i in range(0, len(text), 200))
    rows = [measure(x or b"") for part in parts for x in part]
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * len(COUNTS))], COUNTS)


def base_failed(m: str) -> Column:
    words, repeats = F.col(f"{m}.n_words"), F.col(f"{m}.n_repeat_words")
    return (words < 50) | (100 * repeats > 50 * words)


def ratios(m: str) -> dict[str, Column]:
    def per(a: str, b: str) -> Column:
        return F.col(f"{m}.{a}") / F.greatest(F.col(f"{m}.{b}"), F.lit(1))

    return {
        "symbols": per("n_symbols", "word_chars"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "capitals": per("n_capitals", "word_chars"),
        "shouts": per("n_shouts", "n_words"),
        "cells": per("n_cells", "n_words"),
    }


def strictness(m: str) -> Column:
    """The most lenient rung (0 is the first) that rejects the document; ``RUNGS`` if none does.

    Cutoffs fall along the ladder, so that every stricter rung rejects it too.
    """
    steps = [sum(((x <= c).cast("int") for c in LADDER[rule]), F.lit(0)) for rule, x in ratios(m).items()]
    return F.least(*steps)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exact up to float64."""
    if k >= n:
        return 1.0
    # From the largest term of the sum outwards, each from the one before.
    m = min(k, int((n + 1) * p))
    top = math.exp(math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1) + m * math.log(p) + (n - m) * math.log1p(-p))
    total = term = 1.0
    for i in range(m, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < 1e-18 * total:
            break
    term = 1.0
    for i in range(m + 1, k + 1):
        term *= (n - i + 1) * p / (i * (1 - p))
        total += term
        if term < 1e-18 * total:
            break
    return min(1.0, top * total)


def certified(k: int, n: int, tests: int, alpha: float = ALPHA, delta: float = DELTA) -> bool:
    """Whether k rejections among n good documents bound the rate by alpha at this correction."""
    return n > 0 and k <= alpha * n and binomial_cdf(k, n, alpha) <= delta / tests


def stratum(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(""))


def choose(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, rung) of the strata in which a rung is certified.

    measured: doc_id, stratum, failed, strict. Documents that the base rules reject
    anyway are no evidence about the method's cutoffs and stay out of the holdout.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = measured.where(~F.col("failed")).join(marks, "doc_id")
    good = F.col("quality") >= 1
    sums = [F.count(F.when(good, 1)).alias("good")]
    sums += [F.count(F.when(good & (F.col("strict") <= r), 1)).alias(f"good_{r}") for r in range(RUNGS)]
    sums += [F.count(F.when(~good & (F.col("strict") <= r), 1)).alias(f"junk_{r}") for r in range(RUNGS)]
    counts = cut(held.groupBy("stratum").agg(*sums))
    tests = max(1, counts.count()) * RUNGS

    @F.arrow_udf("int")
    def best(*cols: pa.Array) -> pa.Array:
        out = []
        for n, *rest in zip(*(c.to_pylist() for c in cols)):
            ok = [r for r in range(RUNGS) if rest[RUNGS + r] and certified(rest[r], n, tests)]
            out.append(max(ok, key=lambda r: (rest[RUNGS + r], -r)) if ok else None)
        return pa.array(out, pa.int32())

    return cut(counts.select("stratum", best(*[F.col(c) for c in counts.columns[1:]]).alias("rung")).where("rung IS NOT NULL"))


def judged(df: DataFrame, rungs: DataFrame, key: str, strict: str, out: str) -> DataFrame:
    """``df`` with a column ``out``: whether its stratum's rung rejects the row."""
    small = rungs.count() <= BROADCAST_STRATA
    named = rungs.select(F.col("stratum").alias(key), F.col("rung").alias(out))
    return df.join(F.broadcast(named) if small else named, key, "left").withColumn(out, F.coalesce(F.col(strict) <= F.col(out), F.lit(False)))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document doc_id, the base counts, base_failed and kept; also the language's rung."""
    m = docs.select("doc_id", stratum(F.col("lang")).alias("stratum"), measures("text").alias("m"))
    m = cut(m.select("doc_id", "stratum", "m", base_failed("m").alias("failed"), strictness("m").alias("strict")))
    rows = judged(m, choose(m, labels), "stratum", "strict", "rejected")
    counts = [F.col(f"m.{c}").alias(c) for c in COUNTS[:5]]
    return rows.select("doc_id", *counts, F.col("failed").alias("base_failed"), (~F.col("failed") & ~F.col("rejected")).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``.

    Texts are measured twice, once for the holdout and once on the way out: that
    moves no text between machines.
    """
    m = docs.select("doc_id", stratum(F.col("lang")).alias("stratum"), measures("text").alias("m"))
    m = cut(m.select("doc_id", "stratum", base_failed("m").alias("failed"), strictness("m").alias("strict")))
    rungs = choose(m, labels)
    counts, key, strict, out = (fresh(docs, x) for x in ("counts", "stratum", "strict", "rejected"))
    rows = docs.withColumns({counts: measures("text"), key: stratum(F.col("lang"))}).where(~base_failed(counts)).withColumn(strict, strictness(counts))
    return judged(rows, rungs, key, strict, out).where(~F.col(out)).select(*[F.col(f"`{c}`") for c in docs.columns])
