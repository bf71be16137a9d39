"""Grids as DataFrames of cells, with their metadata on the driver.

A grid is one row per cell, ``(row, col, value)``; the name of the value column follows
the grid's type. No data is SQL NULL; a cell that has no row is no data as well.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class GridType(Enum):
    DEM = "DEM"
    FlowDir = "FlowDir"
    FlowAcc = "FlowAcc"
    Mask = "Mask"
    Tree = "Tree"
    Strahler = "Strahler"


#: Value column of each type, the Spark types it may have (the first is the default), and no-data of files.
VALUE = {GridType.DEM: "z", GridType.FlowDir: "dir", GridType.FlowAcc: "acc", GridType.Mask: "m", GridType.Tree: "segment_id", GridType.Strahler: "ord"}
NUMBERS = (T.DoubleType(), T.FloatType(), T.LongType(), T.IntegerType(), T.ShortType())
TYPES = {
    GridType.DEM: NUMBERS,
    GridType.FlowDir: (T.IntegerType(),),
    GridType.FlowAcc: (T.LongType(), T.DoubleType(), T.FloatType(), T.IntegerType()),
    GridType.Mask: (T.BooleanType(),),
    GridType.Tree: (T.LongType(),),
    GridType.Strahler: (T.IntegerType(),),
}
FILE_NODATA = {GridType.FlowDir: 255, GridType.Tree: 0, GridType.Strahler: 0}

#: Direction codes with their steps, in compass order from east (fixed values).
STEPS = ((1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1), (64, -1, 0), (128, -1, 1))
CODES = tuple(code for code, _, _ in STEPS)


@dataclass(frozen=True)
class GridMeta:
    """Extent and georeference: x = c + (col + .5) a and y = f + (row + .5) e at cell centres."""

    nrows: int
    ncols: int
    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = -1.0
    f: float = 0.0
    crs: str | None = None
    #: Whether coordinates are degrees, where the name of the reference system does not tell.
    degrees: bool | None = None

    @property
    def transform(self) -> tuple[float, ...]:
        return self.a, self.b, self.c, self.d, self.e, self.f

    @property
    def geographic(self) -> bool:
        """Without a reference system coordinates count as degrees; codes beyond the usual ones need ``degrees``."""
        if self.crs is None:
            return True
        if self.degrees is not None:
            return self.degrees
        name = self.crs.upper().replace(" ", "")
        return name in ("EPSG:4326", "EPSG:4269", "EPSG:4258", "OGC:CRS84", "CRS84") or name.startswith(("GEOGCS", "GEOGCRS", "+PROJ=LONGLAT"))

    def x(self, col: Column) -> Column:
        return F.lit(self.c) + (col + F.lit(0.5)) * F.lit(self.a)

    def y(self, row: Column) -> Column:
        return F.lit(self.f) + (row + F.lit(0.5)) * F.lit(self.e)

    def coarse(self, k: int, nrows: int, ncols: int) -> GridMeta:
        return replace(self, nrows=nrows, ncols=ncols, a=self.a * k, e=self.e * k)


@dataclass(frozen=True)
class Grid:
    df: DataFrame
    type: GridType
    meta: GridMeta

    @property
    def value(self) -> str:
        return VALUE[self.type]

    @property
    def shape(self) -> tuple[int, int]:
        return self.meta.nrows, self.meta.ncols

    @classmethod
    def create(cls, df: DataFrame, type: GridType, meta: GridMeta, value: str | None = None, nodata: float | None = None) -> Grid:
        """A grid of the columns row, col and ``value``; NaN and ``nodata`` become NULL, types are made canonical."""
        name = VALUE[type]
        value = value or name
        have = df.schema[value].dataType
        x = F.col(value)
        if isinstance(have, (T.DoubleType, T.FloatType)):
            x = F.when(~F.isnan(x), x)
        if nodata is not None and not math.isnan(nodata):
            x = F.when(x != F.lit(nodata), x)
        if type in (GridType.DEM, GridType.FlowAcc):
            if have not in TYPES[type]:
                raise TypeError(f"a {type.value} grid can't hold {have.simpleString()}")
        elif type is GridType.Mask:
            x = F.coalesce(x.cast("double") != 0, F.lit(False)) if not isinstance(have, T.BooleanType) else F.coalesce(x, F.lit(False))
        else:
            x = x.cast(TYPES[type][0])
            if type in FILE_NODATA:
                x = F.when(x != FILE_NODATA[type], x)
        return cls(df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), x.alias(name)), type, meta)

    def with_df(self, df: DataFrame, type: GridType | None = None, meta: GridMeta | None = None) -> Grid:
        return Grid(df, type or self.type, meta or self.meta)

    @property
    def cell(self) -> Column:
        return cell(self.meta)

    def dense(self) -> Grid:
        """Every cell of the extent, with NULL where there was no row."""
        n = self.meta.ncols
        every = self.df.sparkSession.range(self.meta.nrows * n).select(F.expr(f"int(id div {n})").alias("row"), F.expr(f"int(id % {n})").alias("col"))
        return self.with_df(every.join(self.df, ["row", "col"], "left"))

    def rows(self, missing=None) -> list[list]:
        """The values as nested lists; for small grids and tests."""
        out = [[missing] * self.meta.ncols for _ in range(self.meta.nrows)]
        for r, c, v in self.df.select("row", "col", self.value).collect():
            out[r][c] = missing if v is None else v
        return out


def cell(meta: GridMeta, row: str | Column = "row", col: str | Column = "col") -> Column:
    """The 64-bit number of a cell in row-major order."""
    row, col = (F.col(x) if isinstance(x, str) else x for x in (row, col))
    return row.cast("long") * F.lit(meta.ncols).cast("long") + col.cast("long")


def uncell(meta: GridMeta, name: str) -> tuple[Column, Column]:
    """Row and column of a cell number."""
    return F.expr(f"int({name} div {meta.ncols})").alias("row"), F.expr(f"int({name} % {meta.ncols})").alias("col")


def from_rows(spark: SparkSession, rows: Sequence[Sequence], type: GridType, dtype: str | None = None, nodata: float | None = None, **georeference) -> Grid:
    """A grid literal."""
    meta = GridMeta(len(rows), len(rows[0]) if rows else 0, **georeference)
    name = VALUE[type]
    data = [(i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)]
    default = {GridType.DEM: "double", GridType.FlowAcc: "long", GridType.Mask: "boolean"}.get(type, "int")
    return Grid.create(spark.createDataFrame(data, f"row int, col int, {name} {dtype or default}"), type, meta, nodata=nodata)


def from_table(df: DataFrame, type: GridType, meta: GridMeta, value: str | None = None) -> Grid:
    """A grid of any DataFrame with columns row, col and a value."""
    return Grid.create(df, type, meta, value)


# Validation: metadata only, no data is scanned.


def check_type(grid: Grid, *types: GridType) -> None:
    if grid.type not in types:
        raise ValueError(f"expected {' or '.join(t.value for t in types)}, got {grid.type.value}")


def check_dtype(grid: Grid, *types: T.DataType) -> None:
    have = grid.df.schema[grid.value].dataType
    if have not in types:
        raise ValueError(f"unexpected value type {have.simpleString()}")


def check_crs(one: Grid, two: Grid) -> None:
    if one.meta.crs != two.meta.crs:
        raise ValueError(f"reference systems differ: {one.meta.crs} and {two.meta.crs}")


def check_shape(one: Grid, two: Grid) -> None:
    if one.shape != two.shape:
        raise ValueError(f"shapes differ: {one.shape} and {two.shape}")


def check_transform(one: Grid, two: Grid) -> None:
    if not all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(one.meta.transform, two.meta.transform)):
        raise ValueError(f"transforms differ: {one.meta.transform} and {two.meta.transform}")


def check_same(one: Grid, two: Grid) -> None:
    check_crs(one, two)
    check_shape(one, two)
    check_transform(one, two)


def check_factor(k: int, even: bool = False) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1 or even and k % 2:
        raise ValueError(f"k must be a positive {'even ' if even else ''}integer, got {k!r}")


def check_aligned(fine: GridMeta, coarse: GridMeta) -> tuple[int, int, int, int]:
    """(ky, kx, first fine row, first fine column) of the coarse grid; ValueError unless cells nest."""
    ratios = coarse.a / fine.a, coarse.e / fine.e
    kx, ky = (round(r) for r in ratios)
    if min(kx, ky) < 1 or any(abs(r - k) > 1e-6 for r, k in zip(ratios, (kx, ky))):
        raise ValueError(f"the coarse pixel is not a whole multiple of the fine one: {ratios}")
    shifts = (coarse.c - fine.c) / fine.a, (coarse.f - fine.f) / fine.e
    col, row = (round(s) for s in shifts)
    if any(abs(s - n) > 1e-6 for s, n in zip(shifts, (col, row))):
        raise ValueError("the coarse origin does not lie on a fine cell's corner")
    if min(row, col) < 0:
        raise ValueError("the coarse grid begins above or left of the fine one")
    return ky, kx, row, col


def illegal_directions(grid: Grid) -> DataFrame:
    """Cells whose direction is no known code; these have no outgoing edge here."""
    check_type(grid, GridType.FlowDir)
    return grid.df.where(F.col("dir").isNotNull() & ~F.col("dir").isin(0, *CODES))
