"""Closures by tiles: one pass inside tiles, a closure of the tiles' exits, one pass back.

Inside a tile each task walks its own cells. Between tiles only exits (cells whose
receiver lies in another tile) are left, about a tile's side for a tile's area, and the
doubling runs on these. Cells are shuffled twice whatever the depth of the drainage.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import GridMeta
from . import closure

#: Cells along a tile's side.
TILE = 512


def local_receivers(frame: pd.DataFrame) -> np.ndarray:
    """The place of each row's receiver in the frame, -1 if it has none there."""
    cells, p = frame["cell"].to_numpy(), frame["p"].fillna(-1).to_numpy().astype(np.int64)
    order = np.argsort(cells)
    at = np.searchsorted(cells, p, sorter=order)
    found = order[np.minimum(at, len(cells) - 1)]
    return np.where((p >= 0) & (cells[found] == p), found, -1)


def drained(to: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums over all rows that drain to each row, itself included; nothing flows around a ring."""
    total = weight.copy()
    waiting = np.bincount(to[to >= 0], minlength=len(to))
    ready = np.flatnonzero(waiting == 0)
    while len(ready):
        ready = ready[to[ready] >= 0]
        np.add.at(total, to[ready], total[ready])
        np.subtract.at(waiting, to[ready], 1)
        below = np.unique(to[ready])
        ready = below[waiting[below] == 0]
    return total


def ends(to: np.ndarray) -> np.ndarray:
    """The last row downstream of each row; some row of the ring for those that end in one."""
    out = np.where(to >= 0, to, np.arange(len(to)))
    for _ in range(max(1, len(to).bit_length())):
        out = out[out]
    return out


def accumulate(edges: DataFrame, meta: GridMeta, kind: str, tile: int = TILE) -> DataFrame:
    """row, col, acc of edges (row, col, cell, p, w); ``kind`` is the type of the weights."""
    where = [F.expr(f"int(row div {tile})").alias("ti"), F.expr(f"int(col div {tile})").alias("tj")]
    own = closure.cut(edges.select("row", "col", "cell", "p", "w", *where))

    def inside(frame: pd.DataFrame) -> pd.DataFrame:
        to = local_receivers(frame)
        cells, total, last = frame["cell"].to_numpy(), drained(to, frame["w"].to_numpy()), ends(to)
        leaves = (to < 0) & frame["p"].notna().to_numpy()
        r, c = frame["row"].to_numpy() % tile, frame["col"].to_numpy() % tile
        rim = (r == 0) | (r == tile - 1) | (c == 0) | (c == tile - 1)
        leads = rim & leaves[last]
        exits = pd.DataFrame({"exit": True, "cell": cells[leaves], "to": frame["p"].to_numpy()[leaves].astype(np.int64), "a": total[leaves]})
        reach = pd.DataFrame({"exit": False, "cell": cells[leads], "to": cells[last[leads]], "a": total[leads]})
        return pd.concat([exits, reach])

    found = closure.cut(own.groupBy("ti", "tj").applyInPandas(inside, f"exit boolean, cell long, to long, a {kind}"))
    exits, reach = found.where("exit"), found.where("NOT exit").select(F.col("cell").alias("to"), F.col("to").alias("p"))
    inflow = None
    if not exits.isEmpty():
        graph = closure.cut(exits.join(reach, "to", "left").select("cell", "p", F.col("a").alias("w"), "to"))
        total = closure.accumulate(graph, cycles=False)
        if total is None:  # a ring through several tiles: cells on it are found by doubling over all cells
            acc = closure.accumulate(own.select("cell", "p", "w"))
            return acc.select(F.expr(f"int(cell div {meta.ncols})").alias("row"), F.expr(f"int(cell % {meta.ncols})").alias("col"), F.col("a").alias("acc"))
        inflow = graph.select("cell", "to").join(total, "cell").groupBy(F.col("to").alias("cell")).agg(F.sum("a").alias("more"))
    else:
        inflow = own.limit(0).select("cell", F.col("w").alias("more"))
    row, col = F.expr(f"int(cell div {meta.ncols})"), F.expr(f"int(cell % {meta.ncols})")
    inflow = inflow.select("cell", "more", F.floor(row / tile).cast("int").alias("ti"), F.floor(col / tile).cast("int").alias("tj"))

    def whole(frame: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({"row": [], "col": [], "acc": []})
        weight = frame["w"].to_numpy().copy()
        order = np.argsort(frame["cell"].to_numpy())
        if len(more):
            weight[order[np.searchsorted(frame["cell"].to_numpy(), more["cell"].to_numpy(), sorter=order)]] += more["more"].to_numpy()
        return pd.DataFrame({"row": frame["row"], "col": frame["col"], "acc": drained(local_receivers(frame), weight)})

    return own.groupBy("ti", "tj").cogroup(inflow.groupBy("ti", "tj")).applyInPandas(whole, f"row int, col int, acc {kind}")


def reaching(edges: DataFrame, meta: GridMeta, target: int, tile: int = TILE) -> DataFrame:
    """The cells ``cell`` of edges (cell, p) from which the target is reached, the target itself included."""
    row, col = F.expr(f"int(cell div {meta.ncols})"), F.expr(f"int(cell % {meta.ncols})")
    where = [F.floor(row / tile).cast("int").alias("ti"), F.floor(col / tile).cast("int").alias("tj")]
    stop = F.when(F.col("cell") != target, F.col("p")).alias("p")
    own = closure.cut(edges.select("cell", stop, row.alias("row"), col.alias("col"), *where))

    def inside(frame: pd.DataFrame) -> pd.DataFrame:
        to, cells = local_receivers(frame), frame["cell"].to_numpy()
        last = ends(to)
        leaves = (to < 0) & frame["p"].notna().to_numpy()
        r, c = frame["row"].to_numpy() % tile, frame["col"].to_numpy() % tile
        rim = (r == 0) | (r == tile - 1) | (c == 0) | (c == tile - 1)
        leads = rim & (leaves[last] | (cells[last] == target))
        exits = pd.DataFrame({"exit": True, "cell": cells[leaves], "to": frame["p"].to_numpy()[leaves].astype(np.int64)})
        return pd.concat([exits, pd.DataFrame({"exit": False, "cell": cells[leads], "to": cells[last[leads]]})])

    found = closure.cut(own.groupBy("ti", "tj").applyInPandas(inside, "exit boolean, cell long, to long"))
    reach = found.where("NOT exit").select(F.col("cell").alias("to"), F.col("to").alias("p"))
    end = edges.sparkSession.createDataFrame([(target, None)], "cell long, p long")
    graph = closure.cut(found.where("exit").join(reach, "to", "left").select("cell", "p").unionByName(end))
    good = closure.roots(closure.without_cycles(graph)[0]).where(F.col("root") == target).select("cell")
    good = good.select("cell", *where)

    def whole(frame: pd.DataFrame, good: pd.DataFrame) -> pd.DataFrame:
        cells = frame["cell"].to_numpy()
        ok = np.isin(cells[ends(local_receivers(frame))], good["cell"].to_numpy()) if len(frame) else []
        return pd.DataFrame({"cell": cells[ok]})

    return own.groupBy("ti", "tj").cogroup(good.groupBy("ti", "tj")).applyInPandas(whole, "cell long")
