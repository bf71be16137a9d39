"""Distances and areas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import STEPS, GridMeta

#: Radius of the sphere in metres (a fixed value).
RADIUS = 6_371_000.0


def spherical_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres, from degrees, by the arctangent form."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    across = F.sqrt(F.pow(F.cos(q) * F.sin(d), 2) + F.pow(F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d), 2))
    along = F.sin(p) * F.sin(q) + F.cos(p) * F.cos(q) * F.cos(d)
    return F.lit(RADIUS) * F.atan2(across, along)


def euclidean_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def cell_area(meta: GridMeta, row: Column | None = None) -> Column:
    """Square kilometres on the sphere; square units of the reference system on a plane."""
    if not meta.geographic:
        return F.lit(abs(meta.a * meta.e))
    row = F.col("row") if row is None else row
    flat = RADIUS**2 * math.radians(abs(meta.a)) * math.radians(abs(meta.e)) / 1e6
    return F.lit(flat) * F.cos(F.radians(meta.y(row)))


def _distance(meta: GridMeta, row: int, dr: int, dc: int) -> float:
    if not meta.geographic:
        return math.hypot(dr * meta.e, dc * meta.a)
    y = meta.f + (row + 0.5) * meta.e
    p, q, d = math.radians(y), math.radians(y + dr * meta.e), math.radians(dc * meta.a)
    across = math.hypot(math.cos(q) * math.sin(d), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d))
    return RADIUS * math.atan2(across, math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(d))


def step_distance(meta: GridMeta, code: Column, row: Column | None = None) -> Column:
    """Metres (units on a plane) from a cell to its neighbour in direction ``code``; NULL for other codes."""
    row = F.col("row") if row is None else row
    if meta.geographic:
        # One distance, with steps that depend on the code.
        dr = dc = F.lit(None).cast("double")
        for c, r, k in STEPS:
            dr, dc = F.when(code == c, float(r)).otherwise(dr), F.when(code == c, float(k)).otherwise(dc)
        y = meta.y(row)
        return spherical_distance(y, F.lit(0.0), y + dr * F.lit(meta.e), dc * F.lit(meta.a))
    out = F.lit(None).cast("double")
    for c, dr, dc in STEPS:
        out = F.when(code == c, F.lit(math.hypot(dr * meta.e, dc * meta.a))).otherwise(out)
    return out


def row_distances(spark: SparkSession, meta: GridMeta) -> DataFrame:
    """(row, code, distance): a table of eight rows for each grid row."""
    data = [(r, c, _distance(meta, r, dr, dc)) for r in range(meta.nrows) for c, dr, dc in STEPS]
    return spark.createDataFrame(data, "row int, code int, distance double")
