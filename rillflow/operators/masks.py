"""Per-cell maps, resampling and global measures of masks and grids."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import cell_area
from ..model import VALUE, Grid, GridType, check_aligned, check_crs, check_factor, check_same, check_type


def threshold_mask(grid: Grid, cutoff: float) -> Grid:
    """True where a flow accumulation or a Strahler order reaches the cutoff; no data is False."""
    check_type(grid, GridType.FlowAcc, GridType.Strahler)
    m = F.coalesce(F.col(grid.value) >= F.lit(cutoff), F.lit(False)).alias("m")
    return grid.with_df(grid.df.select("row", "col", m), GridType.Mask)


def mask_grid(grid: Grid, mask: Grid) -> Grid:
    """The grid where the mask is True, no data (False in a mask) elsewhere."""
    check_type(mask, GridType.Mask)
    check_same(grid, mask)
    x = F.coalesce(F.col(grid.value) & F.col("on"), F.lit(False)) if grid.type is GridType.Mask else F.when(F.col("on"), F.col(grid.value))
    on = mask.df.select("row", "col", F.col("m").alias("on"))
    return grid.with_df(grid.df.join(on, ["row", "col"], "left").select("row", "col", x.alias(grid.value)))


def mask_area(mask: Grid) -> DataFrame:
    """One row ``area``: the area of the True cells."""
    check_type(mask, GridType.Mask)
    # Areas depend on the row only: counts by row first, then one term for each row.
    rows = mask.df.where("m").groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    return rows.agg(F.coalesce(F.sum(F.col("n") * cell_area(mask.meta)), F.lit(0.0)).alias("area"))


def disaggregate_mask(mask: Grid, k: int) -> Grid:
    """Each cell as k x k cells of the same extent."""
    check_type(mask, GridType.Mask)
    check_factor(k)
    meta = replace(mask.meta, nrows=mask.meta.nrows * k, ncols=mask.meta.ncols * k, a=mask.meta.a / k, e=mask.meta.e / k)
    parts = mask.df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return mask.with_df(parts.select((F.col("row") * k + F.col("i")).alias("row"), (F.col("col") * k + F.col("j")).alias("col"), "m"), meta=meta)


def match_grids(reference: Grid, other: Grid) -> Grid:
    """``other`` on the extent of ``reference``: shifted, cropped, and padded with no data (False in a mask)."""
    check_crs(reference, other)
    ky, kx, row, col = check_aligned(reference.meta, other.meta)
    if (ky, kx) != (1, 1):
        raise ValueError("pixel sizes differ")
    x = F.col(other.value)
    inside = (F.col("row") < reference.meta.nrows) & (F.col("col") < reference.meta.ncols)
    moved = other.df.select((F.col("row") + row).alias("row"), (F.col("col") + col).alias("col"), other.value).where(inside)
    out = Grid(moved, other.type, reference.meta).dense()
    return out.with_df(out.df.select("row", "col", F.coalesce(x, F.lit(False)).alias("m"))) if other.type is GridType.Mask else out


def has_data(grid: Grid) -> Column:
    return F.col("m") if grid.type is GridType.Mask else F.col(grid.value).isNotNull()


def crop_grid(grid: Grid) -> Grid:
    """The smallest extent that holds all data; the same grid if nothing goes, ValueError if there is none."""
    box = grid.df.where(has_data(grid)).agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if box[0] is None:
        raise ValueError("the grid has no data")
    top, bottom, left, right = box
    if (top, left, bottom + 1, right + 1) == (0, 0, *grid.shape):
        return grid
    m = grid.meta
    meta = replace(m, nrows=bottom - top + 1, ncols=right - left + 1, c=m.c + left * m.a, f=m.f + top * m.e)
    inside = F.col("row").between(top, bottom) & F.col("col").between(left, right)
    return grid.with_df(grid.df.where(inside).select((F.col("row") - top).alias("row"), (F.col("col") - left).alias("col"), grid.value), meta=meta)


def compare_watersheds(one: Grid, two: Grid) -> tuple[DataFrame, Grid]:
    """(one row ``ochiai2, area_1, area_2, area_both``; mask of the intersection).

    The squared Ochiai coefficient: the common area squared over the product of both.
    """
    check_type(one, GridType.Mask)
    check_type(two, GridType.Mask)
    try:
        check_same(one, two)
    except ValueError as e:
        raise ValueError(f"{e}; disaggregate the coarser mask, then match the grids") from e
    a, b = one.df.select("row", "col", F.col("m").alias("a")), two.df.select("row", "col", F.col("m").alias("b"))
    both = a.join(b, ["row", "col"], "full").select("row", "col", *[F.coalesce(x, F.lit(False)).alias(x) for x in "ab"])
    counts = both.groupBy("row").agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("a", F.col("a")), ("b", F.col("b")), ("ab", F.col("a") & F.col("b")))])
    area = cell_area(one.meta)
    sums = counts.agg(*[F.coalesce(F.sum(F.col(x) * area), F.lit(0.0)).alias(x) for x in ("a", "b", "ab")])
    score = F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("ab") * F.col("ab") / (F.col("a") * F.col("b"))).otherwise(0.0)
    common = Grid(both.select("row", "col", (F.col("a") & F.col("b")).alias(VALUE[GridType.Mask])), GridType.Mask, one.meta)
    return sums.select(score.alias("ochiai2"), F.col("a").alias("area_1"), F.col("b").alias("area_2"), F.col("ab").alias("area_both")), common
