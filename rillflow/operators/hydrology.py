"""Drainage closures: accumulation, watersheds, stream orders, pour cells, area check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import cell_area
from ..model import CODES, Grid, GridMeta, GridType, cell, check_aligned, check_crs, check_same, check_type, uncell
from ..plans import closure, tiled
from .neighbours import pointers, receivers
from .network import chains


def flow_accumulation(fd: Grid, area: bool = True, tile: int = tiled.TILE) -> Grid:
    """Upstream area (DOUBLE) or number of cells (BIGINT) of every cell with data, itself included."""
    edges = receivers(fd).withColumn("w", cell_area(fd.meta) if area else F.lit(1).cast("long"))
    return fd.with_df(tiled.accumulate(edges, fd.meta, "double" if area else "long", tile), GridType.FlowAcc)


def delineate_watershed(fd: Grid, pour_row: int, pour_col: int, tile: int = tiled.TILE) -> Grid:
    """True in the cells that drain through the pour cell, which always counts; ValueError outside the grid."""
    m = fd.meta
    if not (0 <= pour_row < m.nrows and 0 <= pour_col < m.ncols):
        raise ValueError("the pour cell lies outside the grid")
    target = pour_row * m.ncols + pour_col
    edges = receivers(fd).select("cell", "p")
    # The pour cell is a target even without data: edges into it are then not cut.
    own = edges.sparkSession.createDataFrame([(target,)], "cell long")
    into = pointers(fd).where(F.col("p") == target).select("cell", "p")
    edges = edges.join(into.select("cell", F.col("p").alias("_to")), "cell", "left").select("cell", F.coalesce("_to", "p").alias("p"))
    edges = edges.unionByName(own.join(edges, "cell", "left_anti").select("cell", F.lit(None).cast("long").alias("p")))
    basin = tiled.reaching(edges, m, target, tile)
    df = fd.df.select("row", "col", cell(m).alias("cell")).join(basin.withColumn("m", F.lit(True)), "cell", "full")
    return fd.with_df(df.select(*uncell(m, "cell"), F.coalesce("m", F.lit(False)).alias("m")), GridType.Mask)


def strahler_order(fd: Grid) -> Grid:
    """Strahler order of every cell with a direction; NULL in sinks, without data, and on cycles.

    Chains of cells with one inflow take the order of their first cell, found by
    doubling upstream. On the rest orders rise level by level: the cells of order k + 1
    or more are those downstream of a meeting of two inflows of order k or more. Jump
    tables are made once; each level at least halves the cells and is one job over them.
    """
    flowing = fd.with_df(fd.df.where(F.col("dir").isin(*CODES)))
    edges = closure.cut(receivers(flowing).select("cell", "p"))
    edges, cycles = closure.without_cycles(edges)
    if cycles is not None:
        edges = edges.join(cycles, "cell", "left_anti")
        into = edges.where("p IS NOT NULL").join(cycles.withColumnRenamed("cell", "p"), "p", "left_semi").select("cell", F.lit(True).alias("_c"))
        edges = edges.join(into, "cell", "left").select("cell", F.when(F.col("_c").isNull(), F.col("p")).alias("p"))
    edges = closure.cut(edges)
    head = closure.cut(chains(edges, acyclic=True).select("cell", "head"))
    inflow = edges.where("p IS NOT NULL").groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    # The contracted graph: heads of chains, each with an edge to the junction below its chain.
    junction = inflow.where("n > 1").select("p")
    links = edges.join(junction, "p", "left_semi").join(head, "cell").select(F.col("head").alias("cell"), "p")
    nodes = closure.cut(head.select(F.col("head").alias("cell")).distinct().join(links, "cell", "left").select("cell", "p"))
    jumps = [closure.cut(nodes.where("p IS NOT NULL").select("cell", "p"))]
    while not (further := closure.cut(closure._squared(jumps[-1]))).isEmpty():
        jumps.append(further)
    level, orders = 1, nodes.select("cell", F.lit(1).alias("ord"))
    alive = nodes
    while True:
        above = alive.where("p IS NOT NULL").groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("p").alias("cell"))
        for jump in jumps:  # all cells downstream, by jumps of 1, 2, 4 ... steps
            above = above.join(jump, "cell", "left").select(F.explode(F.array("cell", "p")).alias("cell")).where("cell IS NOT NULL").distinct()
        above = closure.cut(above)
        if above.isEmpty():
            break
        level += 1
        orders = orders.unionByName(above.select("cell", F.lit(level).alias("ord")))
        alive = nodes.join(above, "cell", "left_semi")
    top = orders.groupBy("cell").agg(F.max("ord").alias("ord")).withColumnRenamed("cell", "head")
    ranked = head.join(top, "head").select("cell", "ord")
    every = fd.df.select("row", "col", cell(fd.meta).alias("cell")).join(ranked, "cell", "left")
    return fd.with_df(every.select("row", "col", F.col("ord").cast("int").alias("ord")), GridType.Strahler)


def snapped(fa: Grid, x: float, y: float, radius: float) -> DataFrame:
    """At most one row (row, col, acc): the largest accumulation with its centre within ``radius`` of (x, y)."""
    check_type(fa, GridType.FlowAcc)
    m: GridMeta = fa.meta
    rows = sorted((y + s * radius - m.f) / m.e for s in (-1, 1))
    cols = sorted((x + s * radius - m.c) / m.a for s in (-1, 1))
    box = F.col("row").between(int(rows[0]) - 1, int(rows[1]) + 1) & F.col("col").between(int(cols[0]) - 1, int(cols[1]) + 1)
    dx, dy = m.x(F.col("col")) - F.lit(float(x)), m.y(F.col("row")) - F.lit(float(y))
    near = fa.df.where(box & F.col("acc").isNotNull() & (dx * dx + dy * dy <= F.lit(float(radius) ** 2)))
    best = near.agg(F.max_by(F.struct("row", "col", "acc"), F.struct("acc", -F.col("row"), -F.col("col"))).alias("b"))
    return best.where("b IS NOT NULL").select("b.*")


def snap_pour_cell(fa: Grid, x: float, y: float, radius: float) -> tuple[int, int]:
    """(row, col) of the best cell, the first in row-major order of equals; ValueError if there is none."""
    found = snapped(fa, x, y, radius).first()
    if found is None:
        raise ValueError("no valid pour cell within the radius")
    return found.row, found.col


def huac(flowacc_fine: Grid, flowdir_coarse: Grid, flowacc_coarse: Grid, pour_row: int, pour_col: int, *, upstream_area_threshold: float = 0.0) -> tuple[Grid, DataFrame]:
    """(grid of relative errors, table): the coarse cells upstream of the pour cell against the largest fine accumulation in each.

    The table has cell_row, cell_col, max_pixel_row, max_pixel_col, coarse_upstream_area,
    fine_max_upstream_area, relative_upstream_area_error. Cells without direction or
    accumulation stop the search; cells below the threshold only are not reported.
    """
    check_type(flowdir_coarse, GridType.FlowDir)
    check_type(flowacc_coarse, GridType.FlowAcc)
    check_type(flowacc_fine, GridType.FlowAcc)
    check_same(flowdir_coarse, flowacc_coarse)
    check_crs(flowdir_coarse, flowacc_fine)
    m = flowdir_coarse.meta
    ky, kx, off_r, off_c = check_aligned(flowacc_fine.meta, m)
    if not (0 <= pour_row < m.nrows and 0 <= pour_col < m.ncols):
        raise ValueError("the pour cell lies outside the grid")
    acc = flowacc_coarse.df.where("acc IS NOT NULL").select(cell(m).alias("cell"), F.col("acc").cast("double").alias("acc"))
    open_ = flowdir_coarse.with_df(flowdir_coarse.df.where("dir IS NOT NULL").withColumn("cell", cell(m)).join(acc, "cell", "left_semi").select("row", "col", "dir"))
    basin = tiled.reaching(receivers(open_).select("cell", "p"), m, pour_row * m.ncols + pour_col)
    told = basin.join(acc.where(F.col("acc") >= upstream_area_threshold), "cell").select(*uncell(m, "cell"), "acc")
    told = told.withColumnsRenamed({"row": "cell_row", "col": "cell_col", "acc": "coarse_upstream_area"})
    pixel = flowacc_fine.df.where(F.col("acc").isNotNull() & (F.col("row") >= off_r) & (F.col("col") >= off_c))
    keyed = pixel.select(F.expr(f"int((row - {off_r}) div {ky})").alias("cell_row"), F.expr(f"int((col - {off_c}) div {kx})").alias("cell_col"), "row", "col", F.col("acc").cast("double").alias("acc"))
    best = keyed.groupBy("cell_row", "cell_col").agg(F.max_by(F.struct("row", "col", "acc"), F.struct("acc", -F.col("row"), -F.col("col"))).alias("b"))
    error = F.when(F.col("b.acc") > 0, (F.col("coarse_upstream_area") - F.col("b.acc")) / F.col("b.acc"))
    table = told.join(best, ["cell_row", "cell_col"], "left").select(
        "cell_row", "cell_col", F.col("b.row").alias("max_pixel_row"), F.col("b.col").alias("max_pixel_col"), "coarse_upstream_area", F.col("b.acc").alias("fine_max_upstream_area"), error.alias("relative_upstream_area_error")
    )
    error_grid = table.select(F.col("cell_row").alias("row"), F.col("cell_col").alias("col"), F.col("relative_upstream_area_error").cast("float").alias("acc"))
    return flowacc_coarse.with_df(error_grid, GridType.FlowAcc), table
