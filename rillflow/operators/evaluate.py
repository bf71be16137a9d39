"""Scores of coarse flow grids: windroses, their distance, and path agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geodesy import step_distance
from ..model import CODES, Grid, GridType, cell, check_aligned, check_crs, check_type
from ..plans import closure
from .neighbours import pointers
from .network import check_seeds, paths


def flowdir_windrose(flowdir: Grid, *, dist: bool = True) -> DataFrame:
    """Eight rows (bin, dir, total, share): metres (or cells) by direction, and their share (zeros if there are none)."""
    check_type(flowdir, GridType.FlowDir)
    spark = flowdir.df.sparkSession
    every = spark.createDataFrame(list(enumerate(CODES)), "bin int, dir int")
    flowing = flowdir.df.where(F.col("dir").isin(*CODES))
    by_row = flowing.groupBy("row", "dir").agg(F.count(F.lit(1)).alias("n"))  # distances depend on the row only
    unit = step_distance(flowdir.meta, F.col("dir")) if dist else F.lit(1.0)
    sums = by_row.groupBy("dir").agg(F.sum(F.col("n") * unit).alias("total"))
    rose = every.join(sums, "dir", "left").select("bin", "dir", F.coalesce("total", F.lit(0.0)).alias("total"))
    whole = F.sum("total").over(W.partitionBy())  # eight rows
    return rose.withColumn("share", F.when(whole > 0, F.col("total") / whole).otherwise(0.0))


def windrose_emd(one: DataFrame, two: DataFrame, value: str = "share") -> DataFrame:
    """One row ``emd``: the circular earth mover's distance of two windroses of eight shares, from 0 to 1."""
    for x in (one, two):
        n, total = x.agg(F.count(value), F.sum(value)).first()
        if n != 8 or abs(total - 1) > 1e-6:
            raise ValueError("a windrose needs eight shares that sum to one")
    both = one.select("bin", F.col(value).alias("a")).join(two.select("bin", F.col(value).alias("b")), "bin")
    run = both.select("bin", F.sum(F.col("a") - F.col("b")).over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)).alias("f"))
    centred = run.crossJoin(F.broadcast(run.agg(F.expr("percentile(f, 0.5)").alias("mid"))))  # eight rows and one
    return centred.agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(F.abs(F.col("f") - F.col("mid"))) / 4)).alias("emd"))


def compare_flowdir(flowdir_fine: Grid, flowdir_coarse: Grid, seeds: DataFrame, *, alpha: float = 0.0, strict_upstream: bool = False, cascade: bool = False) -> DataFrame:
    """(seed_id, score FLOAT): how well the coarse directions follow each seed's fine path; -1 within one coarse cell."""
    check_type(flowdir_fine, GridType.FlowDir)
    check_type(flowdir_coarse, GridType.FlowDir)
    check_crs(flowdir_fine, flowdir_coarse)
    check_seeds(seeds, TypeError)
    f, m = flowdir_fine.meta, flowdir_coarse.meta
    ky, kx, off_r, off_c = check_aligned(f, m)
    mouth = seeds.select("seed_id", cell(f, "mouth_row", "mouth_col").alias("mouth"))
    walk = paths(seeds, flowdir_fine).join(mouth, "seed_id")
    r, c = F.expr(f"int(floor((cell div {f.ncols} - {off_r}) / {ky}))"), F.expr(f"int(floor((cell % {f.ncols} - {off_c}) / {kx}))")
    inside = r.between(0, m.nrows - 1) & c.between(0, m.ncols - 1)
    by_seed = W.partitionBy("seed_id").orderBy("pos")
    before = by_seed.rowsBetween(W.unboundedPreceding, 0)
    walk = walk.withColumn("coarse", F.when(inside, cell(m, r, c)))
    # The path ends at the first pass of the mouth and before the first cell outside the coarse grid.
    walk = walk.withColumn("_past", F.coalesce(F.lag(F.col("cell") == F.col("mouth")).over(by_seed), F.lit(False)) | F.col("coarse").isNull())
    walk = walk.withColumn("_ended", F.max(F.col("_past").cast("int")).over(before)).where("_ended = 0")
    # Runs of equal coarse cells.
    change = F.coalesce(F.col("coarse") != F.lag("coarse").over(by_seed), F.lit(False)).cast("long")
    runs = walk.withColumn("_change", change).withColumn("ic", F.sum("_change").over(before)).groupBy("seed_id", "ic").agg(F.first("coarse").alias("coarse"), F.count(F.lit(1)).alias("n"))
    runs = closure.cut(runs.withColumn("last", F.max("ic").over(W.partitionBy("seed_id"))))
    # Follow the coarse directions from every run but the last until a cell of the path.
    edges = closure.cut(pointers(flowdir_coarse).select("cell", "p"))
    links = edges.where("p IS NOT NULL")
    spots = runs.select("seed_id", F.col("coarse").alias("at"), F.col("ic").alias("pos"))
    open_ = runs.where("ic < last").select("seed_id", "ic", F.col("coarse").alias("cell"))
    later = F.col("pos") > F.col("ic") if strict_upstream or cascade else F.col("pos") != F.col("ic")
    landed = first_hits(open_, links, spots, later)
    state = runs.select("seed_id", "ic", "n", "last").join(landed, ["seed_id", "ic"], "left")
    if cascade:
        # A run is right if the chain of landings ends at the path's last cell.
        stride = (runs.agg(F.max("ic")).first()[0] or 0) + 1
        key = F.col("seed_id") * stride + F.col("ic")
        keyed = closure.cut(state.withColumn("cell", key).withColumn("p", F.when((F.col("ic") < F.col("last")) & F.col("landed").isNotNull(), F.col("seed_id") * stride + F.col("landed"))))
        ends = closure.roots(keyed.select("cell", "p")).select("cell", "root")
        state = keyed.join(ends, "cell").withColumn("right", F.col("root") == F.col("seed_id") * stride + F.col("last"))
    else:
        state = state.withColumn("right", F.col("landed").isNotNull())
    counted = state.where("ic < last").groupBy("seed_id").agg(F.sum(F.when(F.col("right"), F.col("n") / (1 + F.col("off") * F.lit(float(alpha))))).alias("got"), F.sum("n").alias("total"))
    score = F.coalesce(F.col("got"), F.lit(0.0)) / F.col("total")
    return seeds.select("seed_id").join(counted, "seed_id", "left").select("seed_id", F.coalesce(score, F.lit(-1.0)).cast("float").alias("score"))


def first_hits(open_: DataFrame, links: DataFrame, spots: DataFrame, later: Column) -> DataFrame:
    """(seed_id, ic, landed, off) of the walks (seed_id, ic, cell) along ``links`` that reach a spot (seed_id, at, pos).

    off counts the steps before the first spot, landed is the least ``later`` position there.
    A round covers twice the steps of the one before, enumerated from the longest jump
    down, so that rounds are the logarithm of the longest walk and a walk is listed to at
    most twice the length that it needs.
    """
    parts, jumps, limit, past = [], [links], None, 0
    for k in range(64):
        rows = open_.join(links, "cell").select("seed_id", "ic", F.col("p").alias("at"), F.lit(past).cast("long").alias("off"))
        for j in reversed(range(k)):
            ahead = jumps[j].select(F.col("cell").alias("at"), F.col("p").alias("_far"))
            both = F.array(F.struct("at", "off"), F.struct(F.col("_far").alias("at"), (F.col("off") + (1 << j)).alias("off")))
            rows = rows.join(ahead, "at", "left").select("seed_id", "ic", F.explode(both).alias("x")).select("seed_id", "ic", "x.at", "x.off").where("at IS NOT NULL")
        hits = rows.join(spots, ["seed_id", "at"]).groupBy("seed_id", "ic", "off").agg(F.min(F.when(later, F.col("pos"))).alias("landed"))
        parts.append(closure.cut(hits.groupBy("seed_id", "ic").agg(F.min(F.struct("off", "landed")).alias("x")).select("seed_id", "ic", "x.landed", "x.off")))
        past += 1 << k
        on = open_.join(jumps[k].withColumnRenamed("p", "_p"), "cell").join(parts[-1].select("seed_id", "ic"), ["seed_id", "ic"], "left_anti")
        open_ = closure.cut(on.select("seed_id", "ic", F.col("_p").alias("cell")))
        if open_.isEmpty():
            break
        if k == 6:  # so long a walk may be on a ring
            limit = longest_walk(links)
        if limit is not None and past > limit:
            break
        jumps.append(closure.cut(closure._squared(jumps[k])))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def longest_walk(edges: DataFrame) -> int:
    """Steps after which a walk has ended or come round."""
    linear, rings = closure.without_cycles(edges)
    linear = linear.unionByName(linear.where("p IS NOT NULL").select("cell", "p").join(linear.select(F.col("cell").alias("p")), "p", "left_anti").select(F.col("p").alias("cell"), F.lit(None).cast("long").alias("p")).distinct())
    depth = closure.roots(linear).agg(F.max("steps")).first()[0] or 0
    return depth + (rings.count() if rings is not None else 0) + 1
