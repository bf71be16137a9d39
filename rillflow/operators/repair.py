"""Ordered repair of conflicting directions on coarse grids.

The rules rewrite 2 x 2 windows in row-major order, each rewrite being seen by the
next window. Order only matters where windows touch, so the grid falls into
independent regions around its conflicts: buckets of cells that hold a conflict are
joined to components, each component is repaired in order by one task, and components
run in parallel. If a rewrite reaches the rim of a region, all regions are widened and
repaired again from the start, so that the result is that of one ordered scan.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import STEPS, Grid, GridMeta
from ..plans import closure
from .neighbours import around

# Fixed values. A crossing: two cells of a window with their codes, the two cells whose
# heights are compared, and the code that straightens the loser. Cells are TL TR BL BR.
TL, TR, BL, BR = (0, 0), (0, 1), (1, 0), (1, 1)
DMM_CROSSINGS = (
    (TL, 2, TR, 8, TL, TR, TR, TL, 4),
    (BL, 128, BR, 32, TL, TR, BL, BR, 64),
    (TR, 8, BR, 32, TL, BL, TR, BR, 16),
    (TL, 2, BL, 128, TR, BR, TL, BL, 1),
)
COTAT_CROSSINGS = (
    (BL, 128, BR, 32, TL, TR, BL, BR, 64),
    (TL, 2, TR, 8, BR, BL, TR, TL, 4),
    (TR, 8, BR, 32, TL, BL, TR, BR, 16),
    (TL, 2, BL, 128, TR, BR, TL, BL, 1),
)
#: Codes that point at each other: a cell's code, the step, the neighbour's code.
COUNTER = ((1, (0, 1), 16), (4, (1, 0), 64), (2, (1, 1), 32), (128, (-1, 1), 8))
STEP = {code: (dr, dc) for code, dr, dc in STEPS}
PASSES = 4


class Region:
    """Directions and heights of some cells of a grid; rewrites are noted."""

    def __init__(self, frame: pd.DataFrame, nrows: int, ncols: int, nothing: float):
        at = list(zip(frame["row"].tolist(), frame["col"].tolist()))
        self.dir = {p: int(d) if d == d and d is not None else None for p, d in zip(at, frame["dir"].tolist())}
        self.height = {p: h if h == h and h is not None else nothing for p, h in zip(at, frame["mx"].tolist())}
        self.nrows, self.ncols = nrows, ncols
        self.changed: set[tuple[int, int]] = set()
        self.windows = [p for p in sorted(at) if self.whole(*p)]

    def whole(self, i: int, j: int) -> bool:
        return i < self.nrows - 1 and j < self.ncols - 1 and all((i + r, j + c) in self.dir for r, c in (TL, TR, BL, BR))

    def put(self, cell: tuple[int, int], code: int) -> None:
        self.dir[cell] = code
        self.changed.add(cell)

    def reached_rim(self) -> bool:
        around_ = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
        return any((i + r, j + c) not in self.dir for i, j in self.changed for r, c in around_ if 0 <= i + r < self.nrows and 0 <= j + c < self.ncols)

    def crossings(self, rules) -> bool:
        found = False
        for i, j in self.windows:
            for a, x, b, y, first, second, one, two, code in rules:
                if self.dir[i + a[0], j + a[1]] == x and self.dir[i + b[0], j + b[1]] == y:
                    higher = self.height[i + first[0], j + first[1]] > self.height[i + second[0], j + second[1]]
                    loser = one if higher else two
                    self.put((i + loser[0], j + loser[1]), code)
                    found = True
        return found

    def counter_flows(self) -> None:
        for i, j in self.windows:
            for x, (dr, dc), y in COUNTER:
                other = i + dr, j + dc
                if self.dir[i, j] == x and self.dir.get(other) == y:
                    self.put((i, j) if self.height[i, j] > self.height[other] else other, 0)

    def receiver(self, cell: tuple[int, int]) -> tuple[int, int] | None:
        step = STEP.get(self.dir[cell])
        to = step and (cell[0] + step[0], cell[1] + step[1])
        return to if to and self.dir.get(to) is not None else None

    def small_cycles(self) -> bool:
        found = False
        for start in sorted(self.dir):
            if not self.dir[start]:
                continue
            path, cell = [], start
            while cell is not None and cell not in path and len(path) < 9:
                path.append(cell)
                cell = self.receiver(cell)
            if cell is None or cell not in path:
                continue
            ring = path[path.index(cell) :]
            rows, cols = [r for r, _ in ring], [c for _, c in ring]
            if 2 <= len(ring) <= 4 and max(rows) - min(rows) <= 1 and max(cols) - min(cols) <= 1:
                self.put(min(ring, key=lambda c: self.height[c]), 0)
                found = True
        return found


def dmm_rules(region: Region) -> None:
    region.counter_flows()
    for _ in range(PASSES):
        if not region.crossings(DMM_CROSSINGS):
            break
    for _ in range(PASSES):
        if not region.small_cycles():
            break


def cotat_rules(region: Region) -> None:
    region.crossings(COTAT_CROSSINGS)


#: SQL over a window's codes tl, tr, bl, br (and ne, north-east of tl) that finds conflicts.
CROSSED = "(tl = 2 AND tr = 8) OR (bl = 128 AND br = 32) OR (tr = 8 AND br = 32) OR (tl = 2 AND bl = 128)"
OPPOSED = "(tl = 1 AND tr = 16) OR (tl = 4 AND bl = 64) OR (tl = 2 AND br = 32) OR (tl = 128 AND ne = 8) OR (tr = 8 AND bl = 128) OR (tr = 4 AND br = 64) OR (bl = 1 AND br = 16)"
# Places 0..3 are tl, tr, bl, br; a code leads to another place of the window or to none.
_NEXT = "array(CASE tl WHEN 1 THEN 1 WHEN 4 THEN 2 WHEN 2 THEN 3 END, CASE tr WHEN 16 THEN 0 WHEN 8 THEN 2 WHEN 4 THEN 3 END, CASE bl WHEN 64 THEN 0 WHEN 128 THEN 1 WHEN 1 THEN 3 END, CASE br WHEN 32 THEN 0 WHEN 64 THEN 1 WHEN 16 THEN 2 END)"
RINGED = f"exists(transform(array({_NEXT}), n -> exists(sequence(0, 3), x -> n[n[x]] = x OR n[n[n[x]]] = x OR n[n[n[n[x]]]] = x)), b -> b)"


def conflicts(coarse: Grid, where: str) -> DataFrame:
    """(row, col) of the upper left cells of windows in conflict."""
    w = around(coarse).select("row", "col", F.col("dir").alias("tl"), F.col("v1").alias("tr"), F.col("v4").alias("bl"), F.col("v2").alias("br"), F.col("v128").alias("ne"))
    return w.where(F.expr(where)).select("row", "col")


def components(buckets: DataFrame, width: int) -> DataFrame:
    """(cell, root) of buckets ``cell`` (numbered row by row) joined where they touch, corners included."""
    label = closure.cut(buckets.select("cell", F.col("cell").alias("root")))
    near = F.explode(F.array(*[F.lit(r * width + c).cast("long") for r in (-1, 0, 1) for c in (-1, 0, 1)]))
    pairs = closure.cut(buckets.select("cell", near.alias("d")).select("cell", (F.col("cell") + F.col("d")).alias("b")).join(buckets.select(F.col("cell").alias("b")), "b"))
    while True:
        named = pairs.join(label, "cell").select("b", F.col("root").alias("own")).join(label.withColumnRenamed("cell", "b"), "b")
        least = closure.cut(named.groupBy(F.col("own").alias("cell")).agg(F.min("root").alias("least")).select("cell", F.when(F.col("least") < F.col("cell"), F.col("least")).alias("p")))
        if least.where("p IS NOT NULL").isEmpty():
            return label
        top = closure.roots(least).select(F.col("cell").alias("root"), F.col("root").alias("top"))
        label = closure.cut(label.join(top, "root").select("cell", F.col("top").alias("root")))


def repaired(coarse: Grid, heights: DataFrame, where: str, rules: Callable[[Region], None], nothing: float) -> Grid:
    """``coarse`` after the rules; heights: (row, col, mx). ``nothing`` is the height of a cell without one."""
    m: GridMeta = coarse.meta
    full = closure.cut(coarse.dense().df.join(heights.select("row", "col", "mx"), ["row", "col"], "left"))
    hot = closure.cut(conflicts(coarse.with_df(full.select("row", "col", "dir")), where))
    if hot.isEmpty():
        return coarse.with_df(full.select("row", "col", "dir"))
    reach = 1
    while True:
        size = 2 * reach + 2
        width = m.ncols // size + 3  # with a rim, so that neighbours in number are neighbours in place

        def bucket(r, c, size=size, width=width):
            return (F.floor(r / size) + 1) * F.lit(width).cast("long") + F.floor(c / size) + 1

        marked = hot.select(F.explode(F.array(*[F.struct((F.col("row") + r).alias("r"), (F.col("col") + c).alias("c")) for r, c in (TL, TR, BL, BR)])).alias("x"))
        labels = components(closure.cut(marked.select(bucket(F.col("x.r"), F.col("x.c")).alias("cell")).distinct()), width)
        corners = F.array_distinct(F.array(*[bucket(F.col("row") + r, F.col("col") + c) for r in (-reach, reach) for c in (-reach, reach)]))
        inside = full.withColumn("cell", F.explode(corners)).join(labels, "cell").dropDuplicates(["row", "col"])

        def work(key, frame):
            region = Region(frame, m.nrows, m.ncols, nothing)
            rules(region)
            rim = region.reached_rim()
            return pd.DataFrame([(r, c, region.dir[r, c], rim) for r, c in sorted(region.changed)], columns=["row", "col", "new", "rim"])

        changed = closure.cut(inside.select("root", "row", "col", "dir", "mx").groupBy("root").applyInPandas(work, "row int, col int, new int, rim boolean"))
        if changed.where("rim").isEmpty():
            df = full.join(changed.select("row", "col", "new"), ["row", "col"], "left")
            return coarse.with_df(df.select("row", "col", F.coalesce("new", "dir").alias("dir")))
        reach *= 2
