"""River networks: chains, trees of segments, seeds, and lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geodesy import step_distance
from ..model import CODES, Grid, GridMeta, GridType, cell, check_same, check_type, uncell
from ..plans import closure
from .neighbours import pointers, receivers

SEED_FIELDS = ("mouth_row", "mouth_col", "headwater_row", "headwater_col", "ncells", "acc")


def chains(edges: DataFrame, acyclic: bool = False) -> DataFrame:
    """(cell, head, steps): the start of the chain of cells with one inflow that each cell is on.

    Cells with no inflow or several start a chain. Closed rings, which have no start,
    are left out; they are not looked for if the edges are known to be ``acyclic``.
    """
    inflow = edges.where("p IS NOT NULL").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("cell").alias("up"))
    single = inflow.where("n = 1").select(F.col("p").alias("cell"), "up")
    up = closure.cut(edges.select("cell").join(single, "cell", "left").select("cell", F.col("up").alias("p")))
    up, rings = (up, None) if acyclic else closure.without_cycles(up)
    if rings is not None:
        up = closure.cut(up.join(rings, "cell", "left_anti"))
    return closure.roots(up).select("cell", F.col("root").alias("head"), "steps")


def tree_edges(fd: Grid, fa: Grid, mask: Grid | None) -> DataFrame:
    """Eligible cells: cell, row, col, dir, acc and p, the receiver whose heaviest inflow the cell is (else NULL)."""
    m = fd.meta
    flow = pointers(fd).where(F.col("dir").isin(*CODES))
    if mask is not None:
        flow = flow.join(mask.df.where("m").select(cell(m).alias("cell")), "cell", "left_semi")
    acc = fa.df.where("acc > 0").select(cell(m).alias("cell"), "acc")
    own = flow.join(acc, "cell")
    # Place of the inflow as seen from the receiver, in compass order: the opposite of its direction.
    place = F.lit(0)
    for i, code in enumerate(CODES):
        place = F.when(F.col("dir") == code, (i + 4) % 8).otherwise(place)
    into = own.join(own.select(F.col("cell").alias("p"), F.col("acc").alias("acc_p")), "p").withColumn("place", place)
    heavy = into.groupBy("p").agg(F.max_by(F.struct("cell", "acc", "acc_p"), F.struct("acc", "place")).alias("h")).select(F.col("h.cell").alias("cell"), "p", (F.col("h.acc") >= F.col("h.acc_p")).alias("tie"))
    return closure.cut(own.drop("p").join(heavy, "cell", "left"))


def river_tree(flowdir: Grid, flowacc: Grid, mask: Grid | None = None) -> tuple[Grid, DataFrame]:
    """(segment numbers, seeds): heaviest paths upstream, numbered by (accumulation of the mouth descending, row, col).

    Of equal inflows the last in compass order goes on. Segments of one cell are dropped.
    Seeds have seed_id, mouth_row, mouth_col, headwater_row, headwater_col, ncells, acc, length_m.
    """
    check_type(flowdir, GridType.FlowDir)
    check_type(flowacc, GridType.FlowAcc)
    check_same(flowdir, flowacc)
    if mask is not None:
        check_type(mask, GridType.Mask)
        check_same(flowdir, mask)
    m = flowdir.meta
    edges = tree_edges(flowdir, flowacc, mask)
    if not edges.where("tie").isEmpty():  # only equal accumulations can close a ring
        edges = closure.without_cycles(edges)[0]
    edges = edges.withColumn("length_m", F.when(F.col("p").isNotNull(), step_distance(m, F.col("dir"))))
    labelled = closure.cut(closure.roots(edges.select("cell", "p", "length_m"), ("length_m",)))
    ends = labelled.groupBy("root").agg(F.max("steps").alias("steps"), F.max_by("cell", F.struct("steps", "cell")).alias("headwater"), F.max("length_m").alias("length_m")).where("steps > 0")
    mouths = ends.join(edges.select(F.col("cell").alias("root"), "acc"), "root")
    seeds = ranked(mouths, [F.col("acc").desc(), F.col("root").asc()], "seed_id")
    (mr, mc), (hr, hc) = uncell(m, "root"), uncell(m, "headwater")
    seeds = closure.cut(seeds.select("seed_id", "root", mr.alias("mouth_row"), mc.alias("mouth_col"), hr.alias("headwater_row"), hc.alias("headwater_col"), (F.col("steps") + 1).alias("ncells"), "acc", "length_m"))
    ids = labelled.join(seeds.select("root", F.col("seed_id").alias("segment_id")), "root").select("cell", "segment_id")
    tree = flowdir.df.select("row", "col", cell(m).alias("cell")).join(ids, "cell", "left").select("row", "col", "segment_id")
    return flowdir.with_df(tree, GridType.Tree), seeds.drop("root")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place in a global order from 1, without bringing all rows into one task.

    A range shuffle sorts; places within partitions are shifted by the counts of the
    partitions before, a table of one row for each partition.
    """
    parts = closure.cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_local", local).join(shift, "_part").withColumn(name, (F.col("_shift") + F.col("_local")).cast("long")).drop("_part", "_local", "_shift")


def check_seeds(seeds: DataFrame, error: type[Exception] = ValueError) -> None:
    missing = [f for f in SEED_FIELDS if f not in seeds.columns]
    if missing:
        raise error(f"the seeds lack {missing}")


def paths(seeds: DataFrame, fd: Grid, extra: int = 0) -> DataFrame:
    """(seed_id, pos, cell, dir): the cells of each seed from headwater downstream, at most ncells + extra of them.

    Jump tables of 1, 2, 4 ... steps are squared up, and positions are filled in from
    the longest jump down, so that the rounds are the logarithm of the longest path.
    """
    m = fd.meta
    longest = (seeds.agg(F.max("ncells")).first()[0] or 1) + extra
    links = closure.cut(receivers(fd).where("p IS NOT NULL").select("cell", "p"))
    jumps = [links]
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))) - 1)):
        jumps.append(closure.cut(closure._squared(jumps[-1])))
    at = seeds.select("seed_id", (F.col("ncells") + extra).alias("n"), F.lit(0).cast("long").alias("pos"), cell(m, "headwater_row", "headwater_col").alias("cell"))
    for t in range(len(jumps) - 1, -1, -1):
        further = at.where(F.col("pos") + (1 << t) < F.col("n")).join(jumps[t], "cell")
        at = closure.cut(at.unionByName(further.select("seed_id", "n", (F.col("pos") + (1 << t)).alias("pos"), F.col("p").alias("cell"))))
    known = fd.df.select(cell(m).alias("cell"), "dir")
    return at.join(known, "cell", "left").select("seed_id", "pos", "cell", "dir", "n")


def mask_seeds(seeds: DataFrame, flowdir: Grid, flowacc: Grid, mask: Grid) -> DataFrame:
    """The runs of at least two cells of each seed's path within the mask, as seeds of their own.

    Numbered in the order of the seeds and then downstream; acc is that of the run's mouth.
    """
    check_seeds(seeds)
    check_same(flowdir, flowacc)
    check_same(flowdir, mask)
    m = flowdir.meta
    walk = paths(seeds, flowdir)
    own = walk.join(mask.df.where("m").select(cell(m).alias("cell")), "cell", "left_semi")
    island = F.col("pos") - F.row_number().over(W.partitionBy("seed_id").orderBy("pos"))
    row = F.expr(f"int(cell div {m.ncols})")
    runs = own.withColumn("island", island).withColumn("d", step_distance(m, F.col("dir"), row)).withColumn("last", F.max("pos").over(W.partitionBy("seed_id", "island")))
    found = runs.groupBy("seed_id", "island").agg(
        F.min("pos").alias("pos"), F.min_by("cell", "pos").alias("head"), F.max_by("cell", "pos").alias("mouth"), F.count(F.lit(1)).alias("ncells"), F.coalesce(F.sum(F.when(F.col("pos") < F.col("last"), F.col("d"))), F.lit(0.0)).alias("length_m")
    )
    acc = flowacc.df.select(cell(m).alias("mouth"), "acc")
    kept = found.where("ncells > 1").join(acc, "mouth", "left").withColumnRenamed("seed_id", "parent_id")
    out = ranked(kept, [F.col("parent_id").asc(), F.col("pos").asc()], "seed_id")
    (mr, mc), (hr, hc) = uncell(m, "mouth"), uncell(m, "head")
    return out.select("seed_id", mr.alias("mouth_row"), mc.alias("mouth_col"), hr.alias("headwater_row"), hc.alias("headwater_col"), "ncells", "acc", "length_m")


def lines(points: DataFrame, m: GridMeta, key: list[str]) -> DataFrame:
    """One row for each key with path, an array of (x, y) by pos, and its well-known text."""
    r, c = F.expr(f"int(cell div {m.ncols})"), F.expr(f"int(cell % {m.ncols})")
    xy = points.select(*key, F.struct("pos", m.x(c).alias("x"), m.y(r).alias("y")).alias("at"))
    whole = xy.groupBy(*key).agg(F.array_sort(F.collect_list("at")).alias("at"))
    path = F.transform("at", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    path = F.when(F.size("at") == 1, F.concat(path, path)).otherwise(path)
    return whole.select(*key, path.alias("path")).withColumn("wkt", wkt())


def wkt() -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform("path", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def network_points(flowdir: Grid) -> DataFrame:
    """(head, pos, cell) of every line of the network, its last cell being a junction, sink or border cell."""
    edges = closure.cut(receivers(flowdir).select("cell", "p"))
    on = closure.cut(chains(edges))
    junction = edges.where("p IS NOT NULL").groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("p")
    ends = edges.join(junction, "p", "left_semi").join(on, "cell").select("head", (F.col("steps") + 1).alias("pos"), F.col("p").alias("cell"))
    points = on.select("head", F.col("steps").alias("pos"), "cell").unionByName(ends)
    return points.join(points.where("pos = 1").select("head"), "head", "left_semi")


def vectorize_network(flowdir: Grid, flowacc: Grid | None = None) -> DataFrame:
    """Lines start_row, start_col, path, wkt (and flowacc at the last cell) from each head or junction to the next."""
    check_type(flowdir, GridType.FlowDir)
    m = flowdir.meta
    points = closure.cut(network_points(flowdir))
    out = lines(points, m, ["head"])
    r, c = uncell(m, "head")
    if flowacc is not None:
        check_same(flowdir, flowacc)
        last = points.groupBy("head").agg(F.max_by("cell", "pos").alias("cell")).join(flowacc.df.select(cell(m).alias("cell"), F.col("acc").cast("double").alias("flowacc")), "cell", "left")
        out = out.join(last.select("head", "flowacc"), "head")
    return out.select(r.alias("start_row"), c.alias("start_col"), "path", "wkt", *(["flowacc"] if flowacc is not None else []))


def vectorize_tree(seeds: DataFrame, flowdir: Grid, *, cutoff: float | None = None, rank: int | None = None, accuracy: DataFrame | None = None) -> DataFrame:
    """Lines seed_id, path, wkt, flowacc (and accur) of the selected seeds, each with the cell below its mouth.

    accuracy: (seed_id, score), one row for each seed.
    """
    check_type(flowdir, GridType.FlowDir)
    check_seeds(seeds)
    if cutoff is not None and rank is not None:
        raise ValueError("cutoff and rank exclude each other")
    if accuracy is not None and accuracy.count() != seeds.count():
        raise ValueError("accuracy must have one row for each seed")
    if cutoff is not None:
        seeds = seeds.where(F.col("acc") >= cutoff)
    if rank is not None:
        seeds = seeds.orderBy(F.col("acc").desc(), F.col("seed_id").asc()).limit(rank)
    seeds = closure.cut(seeds)
    points = paths(seeds, flowdir, extra=1)
    out = lines(points, flowdir.meta, ["seed_id"]).join(seeds.select("seed_id", F.col("acc").cast("double").alias("flowacc")), "seed_id")
    if accuracy is not None:
        out = out.join(accuracy.select("seed_id", F.col("score").alias("accur")), "seed_id", "left")
    return out
