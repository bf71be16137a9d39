"""Closures of functional graphs (every cell has at most one receiver) by pointer doubling.

A graph is a DataFrame ``(cell, p)``; p is NULL where nothing follows. Each round
squares the pointers, so that the number of rounds is the logarithm of the depth. Rows
whose pointer has run out leave the doubling, and every round's state is cut from its
lineage in the shared checkpoint folder.
"""

from __future__ import annotations

import math

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_statistics(df: DataFrame) -> DataFrame:
    """The same rows in a plan without size estimates.

    A checkpoint keeps the estimate of its plan, and that of a join is the product of
    its sides; over many rounds those numbers grow to millions of digits.
    """
    spark = df.sparkSession
    try:
        plain = spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False)
    except (AttributeError, TypeError, Py4JError):  # no such method in this Spark: only planning is slower then
        return df
    return DataFrame(plain, spark)


def cut(df: DataFrame) -> DataFrame:
    """``df`` from the checkpoint folder that the cluster names in ``spark.checkpoint.dir``, or one in the warehouse where that is unset.

    At most the session's number of shuffle partitions are written: unions that are read
    again and again would otherwise multiply theirs from round to round.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return without_statistics(df.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))).checkpoint(eager=True))


def _squared(links: DataFrame) -> DataFrame:
    """Pointers twice as far; those that run out are gone."""
    after = links.select(F.col("cell").alias("p"), F.col("p").alias("next"))
    return links.join(after, "p").select("cell", F.col("next").alias("p"))


def _limit(edges: DataFrame) -> int:
    """Rounds after which only cycles can be left."""
    return math.ceil(math.log2(max(2, edges.count()))) + 1


def on_cycles(edges: DataFrame) -> DataFrame:
    """The cells ``cell`` that lie on cycles."""
    links = cut(edges.where("p IS NOT NULL").select("cell", "p"))
    for _ in range(_limit(links)):
        if links.isEmpty():
            break
        links = cut(_squared(links))
    return links.select(F.col("p").alias("cell")).distinct()


def without_cycles(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(edges with those that leave a cycle's cells cut, the cycles' cells or None)."""
    cycles = cut(on_cycles(edges))
    if cycles.isEmpty():
        return edges, None
    marked = cycles.select("cell", F.lit(True).alias("_cycle"))
    others = [c for c in edges.columns if c != "p"]
    return edges.join(marked, "cell", "left").select(*others, F.when(F.col("_cycle").isNull(), F.col("p")).alias("p")), cycles


def accumulate(edges: DataFrame, weight: str = "w", cycles: bool = True) -> DataFrame | None:
    """(cell, a): the weight of each cell and of all cells that drain to it.

    On a cycle nothing flows around; its cells keep their own weight and what reaches
    them from outside the cycle. Without ``cycles`` the result is None if there are any.
    """
    edges = cut(edges.select("cell", "p", weight))
    rounds = _limit(edges)
    for attempt in ("as given", "cycles cut"):
        links = edges.where("p IS NOT NULL").select("cell", "p")
        acc = edges.select("cell", F.col(weight).alias("a"))
        for _ in range(rounds):
            add = links.join(acc, "cell").groupBy("p").agg(F.sum("a").alias("add")).withColumnRenamed("p", "cell")
            acc = cut(acc.join(add, "cell", "left").select("cell", (F.col("a") + F.coalesce(F.col("add"), F.lit(0))).alias("a")))
            links = cut(_squared(links))
            if links.isEmpty():
                return acc
        if not cycles:
            return None
        if attempt == "as given":
            edges = cut(without_cycles(edges)[0])
    raise AssertionError("cycles are cut")


def roots(edges: DataFrame, measures: tuple[str, ...] = ()) -> DataFrame:
    """(cell, root, steps, *measures): the last cell downstream, and sums along the way.

    A measure belongs to the edge that leaves a cell. Edges must be free of cycles.
    """
    named = [F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures]
    own = edges.select("cell", "p", *named)
    start = own.where("p IS NOT NULL").select("cell", F.col("p").alias("root"), F.lit(1).cast("long").alias("steps"), *measures)
    ends = own.where("p IS NULL").select("cell", F.col("cell").alias("root"), F.lit(0).cast("long").alias("steps"), *[(F.col(m) * 0).alias(m) for m in measures])
    done, open_ = cut(ends), cut(start)
    parts = [done]
    while not open_.isEmpty():
        state = open_.withColumn("over", F.lit(False)).unionByName(done.withColumn("over", F.lit(True)))
        after = state.select(F.col("cell").alias("root"), F.col("root").alias("_r"), F.col("steps").alias("_s"), "over", *[F.col(m).alias(f"_{m}") for m in measures])
        moved = cut(open_.join(after, "root").select("cell", F.col("_r").alias("root"), (F.col("steps") + F.col("_s")).alias("steps"), *[(F.col(m) + F.col(f"_{m}")).alias(m) for m in measures], "over"))
        finished, open_ = moved.where("over").drop("over"), moved.where("NOT over").drop("over")
        parts.append(finished)
        done = done.unionByName(finished)
    return done

