"""Coarse flow directions: neighbour search, double maximum, and outlet tracing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import _distance
from ..model import CODES, STEPS, Grid, GridType, check_factor, check_same, check_type
from ..plans import closure
from .neighbours import around, steepest
from .repair import CROSSED, OPPOSED, RINGED, cotat_rules, dmm_rules, repaired

#: Fine cells along a tile's side in the traced upscaler: a tile and its rim fit in one task.
TILE = 1024


def block(name: str, k: int, shift: int = 0) -> Column:
    return F.expr(f"int(({name} + {shift}) div {k})")


def NSA(flowacc: Grid, k: int) -> Grid:
    """Towards the neighbour with the steepest rise of the blocks' largest accumulation."""
    check_type(flowacc, GridType.FlowAcc)
    check_factor(k)
    meta = flowacc.meta.coarse(k, -(-flowacc.meta.nrows // k), -(-flowacc.meta.ncols // k))
    top = flowacc.df.groupBy(block("row", k).alias("row"), block("col", k).alias("col")).agg(F.max("acc").cast("double").alias("acc"))
    coarse = Grid(top, GridType.FlowAcc, meta)
    rise = {c: (F.col(f"v{c}") - F.col("acc")) / F.lit(math.hypot(dr, dc)) for c, dr, dc in STEPS}
    return Grid(steepest(around(coarse), rise, F.col("acc").isNotNull()), GridType.FlowDir, meta)


def central(df: DataFrame, k: int, shift: int) -> DataFrame:
    """(i, j, pr, pc, mx): the largest pixel of each block; of equals the most central, then the first."""
    i, j = block("row", k, shift), block("col", k, shift)
    lr, lc = F.col("row") + shift - i * k, F.col("col") + shift - j * k
    middle = (k - 1) / 2
    far = (lr - middle) * (lr - middle) + (lc - middle) * (lc - middle)
    best = F.max_by(F.struct("row", "col", "acc"), F.struct("acc", -far, -lr, -lc)).alias("b")
    return df.groupBy(i.alias("i"), j.alias("j")).agg(best).select("i", "j", F.col("b.row").alias("pr"), F.col("b.col").alias("pc"), F.col("b.acc").alias("mx"))


def dmm_assigned(flowacc: Grid, k: int) -> tuple[Grid, DataFrame]:
    """(directions before repair, heights (row, col, mx))."""
    check_type(flowacc, GridType.FlowAcc)
    check_factor(k, even=True)
    m = flowacc.meta
    meta = m.coarse(k, m.nrows // k, m.ncols // k)
    pixels = flowacc.df.where("acc IS NOT NULL").select("row", "col", F.col("acc").cast("double").alias("acc"))
    own = central(pixels, k, 0).where((F.col("i") < meta.nrows) & (F.col("j") < meta.ncols))
    own = own.withColumns({"bi": block("pr", k, k // 2), "bj": block("pc", k, k // 2)})
    over = central(pixels, k, k // 2).select(F.col("i").alias("bi"), F.col("j").alias("bj"), block("pr", k).alias("di"), block("pc", k).alias("dj"))
    aims = closure.cut(own.join(over, ["bi", "bj"], "left").select(F.col("i").alias("row"), F.col("j").alias("col"), "mx", "di", "dj"))
    heights = aims.select("row", "col", "mx")
    near = around(Grid(aims.select("row", "col", F.col("mx").alias("acc")), GridType.FlowAcc, meta)).join(aims.select("row", "col", "di", "dj"), ["row", "col"], "left")
    highest = F.greatest(*[F.col(f"v{c}") for c in CODES])
    climb, aimed = F.lit(0), F.lit(0)
    for code, dr, dc in reversed(STEPS):
        climb = F.when(F.col(f"v{code}") == highest, code).otherwise(climb)
        aimed = F.when((F.col("di") == F.col("row") + dr) & (F.col("dj") == F.col("col") + dc) & (F.col(f"v{code}") > F.col("acc")), code).otherwise(aimed)
    itself = (F.col("di") == F.col("row")) & (F.col("dj") == F.col("col"))
    code = F.when(itself, F.when(highest > F.col("acc"), climb).otherwise(0)).otherwise(aimed)
    return Grid(near.select("row", "col", F.when(F.col("acc").isNotNull(), code).alias("dir")), GridType.FlowDir, meta), heights


def DMM(flowacc: Grid, k: int) -> Grid:
    """Double maximum: through the largest pixel of a block and of the shifted block around that pixel; then repaired."""
    coarse, heights = dmm_assigned(flowacc, k)
    return repaired(coarse, heights, f"{OPPOSED} OR {CROSSED} OR {RINGED}", dmm_rules, float("-inf"))


class Tile:
    """Arrays of a tile with a rim of one block, and the outlet pixel of each of its blocks."""

    def __init__(self, frame: pd.DataFrame, i0: int, j0: int, n: int, k: int):
        self.k, self.n, self.i0, self.j0 = k, n, i0, j0
        side = (n + 2) * k
        self.side = side
        self.top, self.left = (i0 - 1) * k, (j0 - 1) * k
        at = (frame["row"].to_numpy() - self.top) * side + frame["col"].to_numpy() - self.left
        self.dir = np.full(side * side, -1, np.int64)
        self.acc = np.zeros(side * side)
        self.dir[at] = frame["dir"].fillna(-1).to_numpy()
        self.acc[at] = frame["acc"].fillna(0).to_numpy()
        self.next = np.full(side * side, -1, np.int64)  # receiver inside the tile; -1 at an end
        r, c = np.divmod(np.arange(side * side), side)
        for code, dr, dc in STEPS:
            own = np.flatnonzero(self.dir == code)
            ok = (r[own] + dr >= 0) & (r[own] + dr < side) & (c[own] + dc >= 0) & (c[own] + dc < side)
            own = own[ok]
            to = own + dr * side + dc
            self.next[own] = np.where(self.dir[to] >= 0, to, -1)
        self.row, self.col = r, c

    def plain_outlets(self) -> np.ndarray:
        n, k = self.n + 2, self.k
        blocks = self.acc.reshape(n, k, n, k).transpose(0, 2, 1, 3).reshape(n * n, k * k)
        best = blocks.argmax(1)
        i, j = np.divmod(np.arange(n * n), n)
        return (i * k + best // k) * self.side + j * k + best % k

    def nonempty(self) -> np.ndarray:
        n, k = self.n + 2, self.k
        return (self.dir.reshape(n, k, n, k) >= 0).any(axis=(1, 3)).ravel()

    def leaving(self) -> np.ndarray:
        """Whether each pixel's direction leads out of its block (data beyond or not)."""
        out = np.zeros(len(self.dir), bool)
        for code, dr, dc in STEPS:
            own = self.dir == code
            out[own] = ((self.row[own] + dr) // self.k != self.row[own] // self.k) | ((self.col[own] + dc) // self.k != self.col[own] // self.k)
        return out

    def long_outlets(self, least: float, metres) -> np.ndarray:
        """Per block the outlet with an upstream path in the block longer than ``least``, or that drains most of it.

        Of the block's exits the one with the largest accumulation that is either; the
        largest pixel where that is no exit. All blocks go together, in arrays.
        """
        n, k, every = self.n + 2, self.k, np.arange(len(self.dir))
        block_of = self.row // k * n + self.col // k
        valid, leaves = self.dir >= 0, self.leaving()
        inner = np.where(leaves, -1, self.next)  # receiver in the block
        end = np.where(inner >= 0, inner, every)
        for _ in range((k * k).bit_length()):
            end = end[end]
        drained = np.bincount(end[valid & leaves[end]], minlength=len(end))
        exits = every[valid & leaves]

        def first_of_each(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            new = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
            return group[new], rows[new]

        # The heaviest inflow of each pixel, the first in compass order of equals.
        place = np.full(129, 8)
        for i, (_, dr, dc) in enumerate(STEPS):
            place[next(c for c, r, s in STEPS if (r, s) == (-dr, -dc))] = i
        into = every[inner >= 0]
        into = into[np.lexsort((place[self.dir[into]], -self.acc[into], inner[into]))]
        up = np.full(len(end), -1)
        target, source = first_of_each(inner[into], into)
        up[target] = source
        # Lengths upstream of the exits, step by step.
        far = np.zeros((self.side, 129))
        for code, dr, dc in STEPS:
            far[:, code] = [metres(self.top + r, -dr, -dc) for r in range(self.side)]
        length, at, open_ = np.zeros(len(exits)), exits.copy(), np.arange(len(exits))
        while len(open_ := open_[up[at[open_]] >= 0]):
            q = up[at[open_]]
            length[open_] += far[self.row[at[open_]], self.dir[q]]
            at[open_] = q
        order = exits[np.lexsort((exits, -drained[exits], block_of[exits]))]
        most = np.zeros(len(end), bool)
        most[first_of_each(block_of[order], order)[1]] = True
        good = exits[(length > least) | most[exits]]
        good = good[np.lexsort((good, -self.acc[good], block_of[good]))]
        shown = every[valid][np.lexsort((every[valid], -self.acc[valid], block_of[valid]))]
        out = self.plain_outlets()
        blocks, tops = first_of_each(block_of[shown], shown)
        out[blocks] = tops
        blocks, chosen = first_of_each(block_of[good], good)
        out[blocks] = np.where(leaves[out[blocks]], chosen, out[blocks])
        return out

    def traced(self, outlets: np.ndarray, threshold: float) -> pd.DataFrame:
        """Directions of the blocks inside the rim, all traced together step by step."""
        n, k = self.n + 2, self.k
        i, j = (x.ravel() for x in np.mgrid[1 : n - 1, 1 : n - 1])
        source = i * n + j
        use = self.nonempty()[source]
        i, j, source = i[use], j[use], source[use]
        start = outlets[source]
        cur, target = start.copy(), np.full(len(source), -1, np.int64)
        open_ = np.arange(len(source))
        for _ in range(9 * k * k + 1):
            if not len(open_):
                break
            to = self.next[cur[open_]]
            bi, bj = self.row[to] // k, self.col[to] // k
            stop = (to < 0) | (abs(bi - i[open_]) > 1) | (abs(bj - j[open_]) > 1)
            ended = open_[stop]
            target[ended] = self.row[cur[ended]] // k * n + self.col[cur[ended]] // k
            open_, to, bi, bj = open_[~stop], to[~stop], bi[~stop], bj[~stop]
            cur[open_] = to
            gain = (outlets[bi * n + bj] == to) & (self.acc[to] - self.acc[start[open_]] > threshold)
            target[open_[gain]] = (bi * n + bj)[gain]
            open_ = open_[~gain]
        target[open_] = source[open_]  # a ring of pixels never ends: a sink
        dr, dc = target // n - i, target % n - j
        code = np.zeros(len(source), np.int64)
        for c, r, s in STEPS:
            code[(dr == r) & (dc == s)] = c
        return pd.DataFrame({"row": i - 1 + self.i0, "col": j - 1 + self.j0, "dir": code, "mx": self.acc[start]})


def cotat_traced(flowdir: Grid, flowacc: Grid, k: int, area_threshold: float, mufp: float | None, tile: int = TILE) -> tuple[Grid, DataFrame]:
    """(directions before repair, heights (row, col, mx) at the outlets)."""
    check_type(flowdir, GridType.FlowDir)
    check_type(flowacc, GridType.FlowAcc)
    check_factor(k)
    check_same(flowdir, flowacc)
    m = flowdir.meta
    meta = m.coarse(k, -(-m.nrows // k), -(-m.ncols // k))
    n = max(1, min(tile // k, max(meta.nrows, meta.ncols)))
    acc = flowacc.df.select("row", "col", F.col("acc").cast("double").alias("acc"))
    both = flowdir.df.join(acc, ["row", "col"], "full").where("dir IS NOT NULL OR acc IS NOT NULL")

    def tiles(name: str) -> Column:
        return F.explode(F.array_distinct(F.array(*[F.floor((block(name, k) + d) / n).cast("int") for d in (-1, 0, 1)])))

    def metres(row: int, dr: int, dc: int) -> float:
        return _distance(m, row, dr, dc)

    def work(key, frame):
        t = Tile(frame, key[0] * n, key[1] * n, n, k)
        return t.traced(t.plain_outlets() if mufp is None else t.long_outlets(mufp, metres), area_threshold)

    rimmed = both.withColumn("ti", tiles("row")).withColumn("tj", tiles("col"))
    done = closure.cut(rimmed.groupBy("ti", "tj").applyInPandas(work, "row int, col int, dir int, mx double"))
    return Grid(done.select("row", "col", "dir"), GridType.FlowDir, meta), done.select("row", "col", "mx")


def COTAT(flowdir: Grid, flowacc: Grid, k: int, *, area_threshold: float = 0, mufp: float | None = None) -> Grid:
    """Tracing from each block's outlet pixel to the next outlet; then diagonal crossings are straightened."""
    coarse, heights = cotat_traced(flowdir, flowacc, k, area_threshold, mufp)
    return repaired(coarse, heights, CROSSED, cotat_rules, 0.0)
