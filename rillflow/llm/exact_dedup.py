"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (Spark's frequent-items sketch) of the digests is built map side,
merged in groups of ``TOGETHER`` tasks and then once more. It names every digest that
holds more than ``SUPPORT`` of the rows. Those candidates are verified by exact counts;
the verified winners, at most 1/``SUPPORT`` rows, are broadcast and their copies are
settled map side, so that no hot group is shuffled. All other digests take the ordinary
shuffle: sums by digest with map-side combine, joined back to the rows, in which no
group exceeds ``SUPPORT`` of the input or is held in memory.

Defined cases: a null or empty text is the empty text; a very long text is hashed whole;
a null ``doc_id`` ranks after all others; of rows that share text and ``doc_id`` one
stays; an empty table gives an empty result; other columns are ignored (or carried
along by :func:`keep_first`, whatever their names).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, cut, fresh

#: Share of the rows from which a digest counts as heavy: at most 1,024 are broadcast.
SUPPORT = 1 / 1024
#: Tasks whose summaries are merged in the first place.
TOGETHER = 256


def digest(text: Column) -> Column:
    """SHA-256, as hex, of the text with each run of white space as one space."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")
    return F.sha2(plain.cast("binary"), 256)


def heavy_hitters(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, keep_id, group_size) of the digests verified to hold ``support`` of the rows."""
    rows = digests.count()
    best = [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    tracked = 1 << math.ceil(math.log2(8 / support))  # the sketch errs by less than 3.5 / tracked, half of the support
    parts = digests.groupBy(F.expr(f"spark_partition_id() div {TOGETHER}").alias("tasks")).agg(F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("sketch"))
    # Grouped by a constant: a global aggregate would make a summary of each empty partition too.
    whole = parts.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    found = whole.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {tracked // 2})")).alias("x")).select(F.col("x.item").alias("digest"), F.col("x.count").alias("about"))
    found = found.where((F.col("about") >= rows * support) & F.col("digest").isNotNull()).select("digest")
    counted = digests.join(F.broadcast(found), "digest", "left_semi").groupBy("digest").agg(*best)
    return cut(counted.where(F.col("group_size") >= max(2, rows * support)))


def decide(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = cut(docs.select("doc_id", digest(F.col("text")).alias("digest")))
    heavy = heavy_hitters(digests, support)
    others = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = others.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    met = digests.join(F.broadcast(heavy), "digest").unionByName(others.join(groups, "digest"))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    losers = met.where(~first).withColumn("kept", F.lit(False))
    # Repeated rows of a winner: one of them stays.
    winners = met.where(first).groupBy("digest", "doc_id", "keep_id", "group_size").agg(F.count(F.lit(1)).alias("copies"))
    winners = winners.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("kept", F.col("copy") == 1)
    out = ["doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")]
    return losers.select(out).unionByName(winners.select(out))


def keep_first(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The documents that stay, with the columns of ``docs``.

    Copies of heavy digests go map side. The other texts meet their group's winner by
    digest and id, so that a group is not one task's either.
    """
    key, null, ident, first, rank = (fresh(docs, x) for x in ("digest", "lost", "ident", "keep", "rank"))
    digests = cut(docs.select("doc_id", digest(F.col("text")).alias("digest")))
    heavy = heavy_hitters(digests, support)
    winners = heavy.select(F.col("digest").alias(key), F.struct("keep_id").alias(first))
    marked = docs.withColumn(key, digest(F.col("text"))).join(F.broadcast(winners), key, "left")
    left = marked.where(F.col(first).isNull() | F.col("doc_id").eqNullSafe(F.col(f"{first}.keep_id")))
    left = left.withColumns({null: F.col("doc_id").isNull(), ident: F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    best = digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
    best = best.select(F.col("digest").alias(key), F.col("keep_id").isNull().alias(null), F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias(ident))
    left = left.join(best, [key, null, ident], "left_semi")
    order = W.partitionBy(key, null, ident).orderBy(F.col("text").asc_nulls_first())
    return left.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
