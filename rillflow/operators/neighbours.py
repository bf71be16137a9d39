"""Operators on the 3 x 3 neighbourhood."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geodesy import spherical_distance
from ..model import CODES, STEPS, Grid, GridMeta, GridType, cell, check_type


def around(grid: Grid) -> DataFrame:
    """row, col, the value, and v1, v2, v4 ... v128: the neighbours' values by direction code.

    Two windows, along rows and then along columns, on a dense frame; cells outside
    the grid or without data are NULL.
    """
    m, x = grid.meta, grid.value
    df = grid.df if grid.df.count() == m.nrows * m.ncols else grid.dense().df
    along, across = W.partitionBy("row").orderBy("col"), W.partitionBy("col").orderBy("row")
    triple = df.withColumns({"v16": F.lag(x).over(along), "v1": F.lead(x).over(along)}).withColumn("three", F.struct(F.col("v16").alias("w"), F.col(x).alias("o"), F.col("v1").alias("e")))
    both = triple.withColumns({"north": F.lag("three").over(across), "south": F.lead("three").over(across)})
    where = {1: "v1", 2: "south.e", 4: "south.o", 8: "south.w", 16: "v16", 32: "north.w", 64: "north.o", 128: "north.e"}
    return both.select("row", "col", x, *[F.col(where[c]).alias(f"v{c}") for c in CODES])


def steepest(df: DataFrame, gradients: dict[int, Column], valid: Column) -> DataFrame:
    """row, col, dir: the code with the largest positive gradient, the first in compass order of equals; 0 if none.

    Gradients and their largest are columns of their own, so that each is computed once.
    """
    named = df.withColumns({f"s{code}": g for code, g in gradients.items()}).withColumn("best", F.greatest(*[F.col(f"s{c}") for c in gradients]))
    out = F.lit(0)
    for code in reversed(gradients):
        out = F.when(F.col(f"s{code}") == F.col("best"), code).otherwise(out)
    return named.select("row", "col", F.when(valid, F.when(F.col("best") > 0, out).otherwise(0)).alias("dir"))


def distances(meta: GridMeta, spherical: bool) -> dict[int, Column]:
    """Distance to the neighbour in each direction; NULL where it is zero."""
    out = {}
    for code, dr, dc in STEPS:
        if spherical and meta.geographic:
            y = meta.y(F.col("row"))
            d = spherical_distance(y, F.lit(0.0), y + F.lit(dr * meta.e), F.lit(dc * abs(meta.a)))
            out[code] = F.when(d > 0, d)
        else:
            out[code] = F.lit(math.hypot(dr * meta.e, dc * meta.a))
    return out


def d8(dem: Grid, spherical: bool = True) -> Grid:
    """Direction of steepest descent; 0 in pits and flats, no data without elevation."""
    check_type(dem, GridType.DEM)
    z = F.col("z").cast("double")
    df = around(dem).withColumns({f"far{code}": d for code, d in distances(dem.meta, spherical).items()})
    down = {code: (z - F.col(f"v{code}").cast("double")) / F.col(f"far{code}") for code in CODES}
    return dem.with_df(steepest(df, down, F.col("z").isNotNull()), GridType.FlowDir)


def steps(code: str = "dir") -> tuple[Column, Column]:
    """Row and column steps of a direction code; NULL for codes without an edge."""
    dr = dc = F.lit(None).cast("int")
    for c, r, k in STEPS:
        dr, dc = F.when(F.col(code) == c, r).otherwise(dr), F.when(F.col(code) == c, k).otherwise(dc)
    return dr, dc


def pointers(fd: Grid) -> DataFrame:
    """row, col, dir, cell and p: the cell that the direction points at inside the grid, whatever its data."""
    check_type(fd, GridType.FlowDir)
    dr, dc = steps()
    m = fd.meta
    r, c = F.col("row") + dr, F.col("col") + dc
    inside = r.between(0, m.nrows - 1) & c.between(0, m.ncols - 1)
    return fd.df.where("dir IS NOT NULL").select("row", "col", "dir", cell(m).alias("cell"), F.when(inside, cell(m, r, c)).alias("p"))


def receivers(fd: Grid, sinks: bool = True) -> DataFrame:
    """row, col, dir, cell and p, the receiver; NULL if it is outside or has no data (or is a sink)."""
    own = pointers(fd)
    valid = own if sinks else own.where(F.col("dir").isin(*CODES))
    return own.join(valid.select(F.col("cell").alias("p"), F.lit(True).alias("_ok")), "p", "left").select("row", "col", "dir", "cell", F.when(F.col("_ok"), F.col("p")).alias("p"))


def in_degree(fd: Grid) -> DataFrame:
    """row, col, n: neighbours that drain into each cell of the grid with data or at least one."""
    own = pointers(fd)
    into = own.where("p IS NOT NULL").groupBy(F.col("p").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    m = fd.meta
    every = own.select("cell").join(into, "cell", "full")
    return every.select(F.expr(f"int(cell div {m.ncols})").alias("row"), F.expr(f"int(cell % {m.ncols})").alias("col"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def upstream_neighbours(fd: Grid) -> DataFrame:
    """row, col, up_row, up_col, place: neighbours that drain into a cell, by place from north-west row by row."""
    own = pointers(fd).where("p IS NOT NULL")
    m = fd.meta
    r, c = F.expr(f"int(p div {m.ncols})"), F.expr(f"int(p % {m.ncols})")
    place = (F.col("row") - r + 1) * 3 + (F.col("col") - c + 1)
    place = F.when(place > 4, place - 1).otherwise(place)
    return own.select(r.alias("row"), c.alias("col"), F.col("row").alias("up_row"), F.col("col").alias("up_col"), place.cast("int").alias("place"))
