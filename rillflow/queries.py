"""One query for each operator and mode on grids derived from the tables, and SQL for their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geodesy import cell_area, row_distances
from .model import STEPS, Grid, GridType
from .operators import evaluate, hydrology, masks, neighbours, network, upscale
from .operators.repair import COTAT_CROSSINGS, COUNTER, DMM_CROSSINGS
from .plans import closure
from .plans.tables import SPHERE, TILT, WIDTH, elevation, parts

K = 4


def flow(spark: SparkSession, sf_dir: str, **how) -> Grid:
    fd = neighbours.d8(elevation(spark, sf_dir, **how))
    return fd.with_df(closure.cut(fd.df))


def counts(spark: SparkSession, sf_dir: str, **how) -> tuple[Grid, Grid]:
    fd = flow(spark, sf_dir, **how)
    return fd, hydrology.flow_accumulation(fd, area=False)


def outlet(fa: Grid) -> tuple[int, int]:
    """The cell with the largest accumulation, the first of equals."""
    top = fa.df.agg(F.max_by(F.struct("row", "col"), F.struct("acc", -F.col("row"), -F.col("col"))).alias("b")).first().b
    return top.row, top.col


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, dir and the number of cells upstream."""
    fd, fa = counts(spark, sf_dir)
    return fd.df.join(fa.df, ["row", "col"])


def basin_mask(fd: Grid, fa: Grid) -> Grid:
    return hydrology.delineate_watershed(fd, *outlet(fa))


def stripes(grid: Grid) -> Grid:
    """A mask of five of every seven diagonals."""
    return grid.with_df(grid.df.select("row", "col", ((F.col("row") + F.col("col")) % 7 < 5).alias("m")), GridType.Mask)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def q_d8_planar(s, d):
    return flow(s, d).df


def q_d8_holes(s, d):
    return flow(s, d, holes=True).df


def q_d8_spherical(s, d):
    return flow(s, d, reference=SPHERE).df


def q_receivers(s, d):
    return neighbours.receivers(flow(s, d, holes=True)).select("cell", "p")


def q_in_degree(s, d):
    return neighbours.in_degree(flow(s, d))


def q_upstream_neighbours(s, d):
    return neighbours.upstream_neighbours(flow(s, d))


def q_cell_area(s, d):
    g = elevation(s, d, reference=SPHERE)
    return rounded(g.df.select("row", "col", cell_area(g.meta).alias("area")), "area")


def q_row_distances(s, d):
    return rounded(row_distances(s, elevation(s, d, reference=SPHERE).meta), "distance", digits=4)


def q_flow_accumulation_count(s, d):
    return counts(s, d)[1].df


def q_flow_accumulation_holes(s, d):
    return counts(s, d, holes=True)[1].df


def q_flow_accumulation_area(s, d):
    return rounded(hydrology.flow_accumulation(flow(s, d, reference=SPHERE)).df, "acc")


def q_flow_accumulation_steep(s, d):
    return counts(s, d, tilt=200_000.0)[1].df


def q_watershed(s, d):
    return basin_mask(*counts(s, d)).df


def q_strahler(s, d):
    return hydrology.strahler_order(flow(s, d, tilt=200_000.0)).df


def q_snap(s, d):
    return hydrology.snapped(counts(s, d)[1], 50.0, -6.0, 4.5)


def q_threshold_mask(s, d):
    return masks.threshold_mask(counts(s, d)[1], 5).df


def q_threshold_mask_strahler(s, d):
    return masks.threshold_mask(hydrology.strahler_order(flow(s, d, tilt=200_000.0)), 2).df


def q_mask_grid(s, d):
    fa = counts(s, d)[1]
    return masks.mask_grid(fa, masks.threshold_mask(fa, 5)).df


def q_mask_area(s, d):
    g = elevation(s, d, reference=SPHERE)
    return rounded(masks.mask_area(stripes(g)), "area", digits=3)


def q_disaggregate_mask(s, d):
    return masks.disaggregate_mask(masks.threshold_mask(parts(s, d), 25), 3).df


def q_match_grids(s, d):
    return masks.match_grids(elevation(s, d), parts(s, d)).df


def q_crop_grid(s, d):
    g = parts(s, d)
    sparse = g.with_df(g.df.withColumn("acc", F.when(F.col("col").between(7, 60) & (F.col("acc") > 10), F.col("acc"))))
    c = masks.crop_grid(sparse)
    return c.df.withColumns({"nrows": F.lit(c.meta.nrows), "ncols": F.lit(c.meta.ncols)})


def q_compare_watersheds(s, d):
    fd, fa = counts(s, d, tilt=200_000.0)
    table, _ = masks.compare_watersheds(masks.threshold_mask(fa, 4), stripes(fd))
    return rounded(table, "ochiai2")


def q_windrose_count(s, d):
    return rounded(evaluate.flowdir_windrose(flow(s, d), dist=False), "share")


def q_windrose_metres(s, d):
    return rounded(evaluate.flowdir_windrose(flow(s, d, reference=SPHERE)), "total", "share", digits=3)


def q_windrose_emd(s, d):
    one, two = (evaluate.flowdir_windrose(flow(s, d, tilt=t), dist=False) for t in (TILT, 200_000.0))
    return rounded(evaluate.windrose_emd(one, two), "emd")


def q_nsa_4(s, d):
    return upscale.NSA(counts(s, d)[1], 4).df


def q_nsa_8(s, d):
    return upscale.NSA(counts(s, d)[1], 8).df


def q_dmm_assign(s, d):
    return upscale.dmm_assigned(counts(s, d)[1], K)[0].df


def q_dmm(s, d):
    return upscale.DMM(counts(s, d)[1], K).df


def q_cotat_trace(s, d):
    return upscale.cotat_traced(*counts(s, d), K, 0, None)[0].df


def q_cotat(s, d):
    return upscale.COTAT(*counts(s, d), K).df


def q_cotat_threshold(s, d):
    return upscale.COTAT(*counts(s, d), K, area_threshold=6).df


def q_cotat_mufp(s, d):
    return upscale.COTAT(*counts(s, d), K, mufp=2.0).df


def q_huac(s, d):
    _, fa = counts(s, d)
    coarse = upscale.NSA(fa, K)
    coarse = coarse.with_df(closure.cut(coarse.df))
    ca = hydrology.flow_accumulation(coarse, area=False)
    return rounded(hydrology.huac(fa, coarse, ca, *outlet(ca), upstream_area_threshold=2)[1], "relative_upstream_area_error")


STEEP = {"tilt": 200_000.0}


def q_river_tree(s, d):
    return network.river_tree(*counts(s, d, **STEEP))[0].df


def q_river_tree_seeds(s, d):
    return rounded(network.river_tree(*counts(s, d, **STEEP))[1], "length_m")


def q_river_tree_masked(s, d):
    fd, fa = counts(s, d, **STEEP)
    return rounded(network.river_tree(fd, fa, stripes(fd))[1], "length_m")


def q_mask_seeds(s, d):
    fd, fa = counts(s, d, **STEEP)
    return rounded(network.mask_seeds(network.river_tree(fd, fa)[1], fd, fa, stripes(fd)), "length_m")


def q_vectorize_network(s, d):
    return network.vectorize_network(*counts(s, d)).select("start_row", "start_col", F.size("path").cast("long").alias("points"), "wkt", "flowacc")


def _tree_lines(s, d, **how):
    fd, fa = counts(s, d, **STEEP)
    return network.vectorize_tree(network.river_tree(fd, fa)[1], fd, **how).select("seed_id", F.size("path").cast("long").alias("points"), "wkt", "flowacc")


def q_vectorize_tree(s, d):
    return _tree_lines(s, d)


def q_vectorize_tree_cutoff(s, d):
    return _tree_lines(s, d, cutoff=12)


def q_vectorize_tree_rank(s, d):
    return _tree_lines(s, d, rank=10)


def _scores(s, d, **how):
    fd, fa = counts(s, d, **STEEP)
    seeds = network.river_tree(fd, fa)[1]
    coarse = upscale.NSA(fa, K)
    return rounded(evaluate.compare_flowdir(fd, coarse.with_df(closure.cut(coarse.df)), seeds, **how).withColumn("score", F.col("score").cast("double")), "score", digits=5)


def q_compare_flowdir(s, d):
    return _scores(s, d)


def q_compare_flowdir_alpha(s, d):
    return _scores(s, d, alpha=0.5)


def q_compare_flowdir_strict(s, d):
    return _scores(s, d, strict_upstream=True)


def q_compare_flowdir_cascade(s, d):
    return _scores(s, d, cascade=True, alpha=0.25)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"flagship": flagship} | {k[2:]: f for k, f in globals().items() if k.startswith("q_")}


# SQL. A query's text is a chain of common table expressions; each names what it needs.

_DIAGONAL = 2**0.5
_STEPS = ", ".join(f"({c}, {i}, {r}, {k}, {1.0 if 0 in (r, k) else _DIAGONAL!r}::DOUBLE)" for i, (c, r, k) in enumerate([(1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1), (64, -1, 0), (128, -1, 1)]))
N8 = f"n8(code, idx, dr, dc, dist) AS (VALUES {_STEPS})"
TOP = f"(SELECT max(o_orderkey) // {WIDTH} + 1 FROM orders)"


def _great_circle(y1: str, y2: str, dx: str) -> str:
    p, q, x = f"radians({y1})", f"radians({y2})", f"radians({dx})"
    return f"6371000.0 * atan2(sqrt(pow(cos({q})*sin({x}),2) + pow(cos({p})*sin({q}) - sin({p})*cos({q})*cos({x}),2)), sin({p})*sin({q}) + cos({p})*cos({q})*cos({x}))"


def _y(row: str) -> str:
    return f"(48.0::DOUBLE + ({row} + 0.5::DOUBLE) * (-0.01::DOUBLE))"


_FAR = _great_circle(_y("a.row"), f"({_y('a.row')} + n.dr * (-0.01::DOUBLE))", "n.dc * 0.01::DOUBLE")


def _grid(tilt: float = TILT, holes: bool = False, s: str = "") -> str:
    z = f"({TOP} - o_orderkey // {WIDTH})::DOUBLE * {tilt}::DOUBLE + o_totalprice"
    z = f"CASE WHEN o_orderstatus <> 'P' THEN {z} END" if holes else z
    return f"g{s} AS (SELECT (o_orderkey // {WIDTH})::INTEGER AS row, (o_orderkey % {WIDTH})::INTEGER AS col, {z} AS z FROM orders)"


def _fd(tilt: float = TILT, holes: bool = False, sphere: bool = False, s: str = "") -> str:
    """The grid's directions fd, its cells with data, and their edges e; ``s`` is appended to the names of a second chain."""
    far = _FAR if sphere else "n.dist"
    return f"""{"" if s else N8 + ", "}{_grid(tilt, holes, s)},
        nb{s} AS (SELECT a.row, a.col, n.code, n.idx, (a.z - b.z) / ({far}) AS slope FROM g{s} a CROSS JOIN n8 n JOIN g{s} b ON b.row = a.row + n.dr AND b.col = a.col + n.dc WHERE a.z IS NOT NULL AND b.z IS NOT NULL),
        best{s} AS (SELECT row, col, code FROM nb{s} WHERE slope > 0 QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY slope DESC, idx) = 1),
        fd{s} AS (SELECT row, col, CASE WHEN z IS NOT NULL THEN coalesce(code, 0) END::INTEGER AS dir FROM g{s} LEFT JOIN best{s} USING (row, col)),
        cells{s} AS (SELECT *, (row * {WIDTH} + col)::BIGINT AS cell FROM fd{s} WHERE dir IS NOT NULL),
        e{s} AS (SELECT a.cell, b.cell AS p, a.dir FROM cells{s} a JOIN n8 ON a.dir = code JOIN cells{s} b ON b.row = a.row + dr AND b.col = a.col + dc)"""


_UP = "up(cell, anc) AS (SELECT cell, cell FROM cells UNION ALL SELECT up.cell, e.p FROM up JOIN e ON up.anc = e.cell)"
_ACC = f"acc AS (SELECT anc AS cell, count(*)::BIGINT AS acc FROM up GROUP BY anc), fa AS (SELECT (cell // {WIDTH})::INTEGER AS row, (cell % {WIDTH})::INTEGER AS col, cell, acc FROM acc)"


def _counts(**how) -> str:
    return f"{_fd(**how)}, {_UP}, {_ACC}"


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


_STRAHLER = (
    "s AS (SELECT e.cell, e.p FROM e JOIN cells c ON c.cell = e.p WHERE c.dir <> 0), r1 AS (SELECT cell FROM cells WHERE dir <> 0), "
    "sup(cell, anc) AS (SELECT cell, cell FROM r1 UNION ALL SELECT sup.cell, s.p FROM sup JOIN s ON sup.anc = s.cell), "
    + ", ".join(f"j{k} AS (SELECT p FROM s JOIN r{k} USING (cell) GROUP BY p HAVING count(*) > 1), r{k + 1} AS (SELECT DISTINCT anc AS cell FROM sup JOIN j{k} ON sup.cell = j{k}.p)" for k in range(1, 9))
    + ", st AS (SELECT fd.row, fd.col, CASE WHEN r1.cell IS NOT NULL THEN 1 "
    + " ".join(f"+ (r{k}.cell IS NOT NULL)::INTEGER" for k in range(2, 10))
    + f" END::INTEGER AS ord FROM fd LEFT JOIN r1 ON r1.cell = fd.row * {WIDTH} + fd.col "
    + " ".join(f"LEFT JOIN r{k} ON r{k}.cell = r1.cell" for k in range(2, 10))
    + ")"
)
_STRIPES = "(row + col) % 7 < 5"
_PART = f"pg AS (SELECT (p_partkey // {WIDTH})::INTEGER AS row, (p_partkey % {WIDTH})::INTEGER AS col, p_size::BIGINT AS acc FROM part)"


def _rose(name: str, total: str) -> str:
    return f"{name} AS (SELECT idx AS bin, code AS dir, coalesce(sum({total}), 0)::DOUBLE AS total FROM n8 LEFT JOIN fd ON fd.dir = code GROUP BY idx, code)"


def _tree(masked: bool = False) -> str:
    where = f"AND {_STRIPES}" if masked else ""
    return f"""ok AS (SELECT c.cell, c.row, c.col, c.dir, a.acc FROM cells c JOIN acc a USING (cell) WHERE c.dir <> 0 {where}),
        heavy AS (SELECT u.cell, e.p, n.dist FROM ok u JOIN e ON e.cell = u.cell JOIN ok d ON d.cell = e.p JOIN n8 n ON n.code = u.dir
                  QUALIFY row_number() OVER (PARTITION BY e.p ORDER BY u.acc DESC, (n.idx + 4) % 8 DESC) = 1),
        seg(mouth, cell, steps, len) AS (SELECT cell, cell, 0::BIGINT, 0.0::DOUBLE FROM ok WHERE cell NOT IN (SELECT cell FROM heavy)
                  UNION ALL SELECT seg.mouth, heavy.cell, seg.steps + 1, seg.len + heavy.dist FROM seg JOIN heavy ON heavy.p = seg.cell),
        ends AS (SELECT mouth, max(steps) + 1 AS ncells, max_by(cell, steps) AS head, max(len) AS len FROM seg GROUP BY mouth HAVING max(steps) > 0),
        ids AS (SELECT ends.*, acc.acc, row_number() OVER (ORDER BY acc.acc DESC, mouth)::BIGINT AS seed_id FROM ends JOIN acc ON acc.cell = mouth)"""


_SEEDS = f"SELECT seed_id, (mouth // {WIDTH})::INTEGER AS mouth_row, (mouth % {WIDTH})::INTEGER AS mouth_col, (head // {WIDTH})::INTEGER AS headwater_row, (head % {WIDTH})::INTEGER AS headwater_col, ncells, acc, round(len, 6) AS length_m FROM ids"
_XY = f"(cell % {WIDTH} + 0.5::DOUBLE)::VARCHAR || ' ' || ((cell // {WIDTH} + 0.5::DOUBLE) * -1)::VARCHAR"
_WKT = f"'LINESTRING (' || string_agg({_XY}, ', ' ORDER BY pos) || ')'"
_NETWORK = """deg AS (SELECT p AS cell, count(*) AS n FROM e GROUP BY p), starts AS (SELECT c.cell FROM cells c LEFT JOIN deg USING (cell) WHERE coalesce(n, 0) <> 1),
    walk(head, cell, pos, over) AS (SELECT cell, cell, 0::BIGINT, false FROM starts
        UNION ALL SELECT w.head, e.p, w.pos + 1, coalesce(deg.n, 0) > 1 FROM walk w JOIN e ON e.cell = w.cell JOIN deg ON deg.cell = e.p WHERE NOT w.over)"""


def _lines(where: str) -> str:
    return f"""points AS (SELECT ids.seed_id, ids.acc, ids.ncells - 1 - steps AS pos, seg.cell FROM ids JOIN seg USING (mouth) UNION ALL SELECT ids.seed_id, ids.acc, ids.ncells, e.p FROM ids JOIN e ON e.cell = ids.mouth)
        SELECT seed_id, count(*)::BIGINT AS points, {_WKT} AS wkt, acc::DOUBLE AS flowacc FROM points {where} GROUP BY seed_id, acc"""


def _block(k: int) -> str:
    return f"""top AS (SELECT (row // {k})::INTEGER AS row, (col // {k})::INTEGER AS col, max(acc)::DOUBLE AS acc FROM fa GROUP BY ALL),
        rise AS (SELECT a.row, a.col, n.code, n.idx, (b.acc - a.acc) / n.dist AS slope FROM top a CROSS JOIN n8 n JOIN top b ON b.row = a.row + n.dr AND b.col = a.col + n.dc),
        way AS (SELECT row, col, code FROM rise WHERE slope > 0 QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY slope DESC, idx) = 1),
        nsa AS (SELECT row, col, coalesce(code, 0)::INTEGER AS dir FROM top LEFT JOIN way USING (row, col))"""


_CW = -(-WIDTH // K)
_COARSE = f"""cc AS (SELECT *, (row * {_CW} + col)::BIGINT AS cell FROM nsa), ce AS (SELECT a.cell, b.cell AS p FROM cc a JOIN n8 ON a.dir = code JOIN cc b ON b.row = a.row + dr AND b.col = a.col + dc)"""


def _score(alpha: float, later: str, cascade: bool = False) -> str:
    right = "chain.ic IS NOT NULL" if cascade else "landed IS NOT NULL"
    chain = f""", chain(seed_id, ic) AS (SELECT seed_id, last FROM runs WHERE ic = last UNION ALL SELECT h.seed_id, h.ic FROM chain JOIN hits h ON h.seed_id = chain.seed_id AND h.landed = chain.ic)""" if cascade else ""
    join = "LEFT JOIN chain USING (seed_id, ic)" if cascade else ""
    return f"""{_tree()}, {_block(K)}, {_COARSE},
        pts AS (SELECT ids.seed_id, ids.ncells - 1 - steps AS pos, ((seg.cell // {WIDTH}) // {K}) * {_CW} + (seg.cell % {WIDTH}) // {K} AS coarse FROM ids JOIN seg USING (mouth)),
        chg AS (SELECT *, (coarse IS DISTINCT FROM lag(coarse) OVER w AND pos > 0)::BIGINT AS c FROM pts WINDOW w AS (PARTITION BY seed_id ORDER BY pos)),
        num AS (SELECT *, sum(c) OVER (PARTITION BY seed_id ORDER BY pos)::BIGINT AS ic FROM chg),
        run0 AS (SELECT seed_id, ic, any_value(coarse) AS coarse, count(*) AS n FROM num GROUP BY seed_id, ic),
        runs AS (SELECT *, max(ic) OVER (PARTITION BY seed_id) AS last FROM run0),
        go(seed_id, ic, spot, off, hit) AS (SELECT r.seed_id, r.ic, ce.p, 0::BIGINT, EXISTS (SELECT 1 FROM runs q WHERE q.seed_id = r.seed_id AND q.coarse = ce.p) FROM runs r JOIN ce ON ce.cell = r.coarse WHERE r.ic < r.last
            UNION ALL SELECT g.seed_id, g.ic, ce.p, g.off + 1, EXISTS (SELECT 1 FROM runs q WHERE q.seed_id = g.seed_id AND q.coarse = ce.p) FROM go g JOIN ce ON ce.cell = g.spot WHERE NOT g.hit),
        hits AS (SELECT go.seed_id, go.ic, go.off, min(q.ic) AS landed FROM go JOIN runs q ON q.seed_id = go.seed_id AND q.coarse = go.spot AND q.ic {later} go.ic WHERE hit GROUP BY ALL){chain},
        sums AS (SELECT seed_id, sum(CASE WHEN {right} THEN n / (1 + off * {alpha}::DOUBLE) ELSE 0 END) / sum(n) AS score FROM runs LEFT JOIN hits USING (seed_id, ic) {join} WHERE ic < last GROUP BY seed_id)
        SELECT seed_id, round(coalesce(score, -1)::FLOAT::DOUBLE, 5) AS score FROM ids LEFT JOIN sums USING (seed_id)"""


def _central(name: str, shift: int) -> str:
    lr, lc = f"(row + {shift}) % {K}", f"(col + {shift}) % {K}"
    return f"""{name} AS (SELECT (row + {shift}) // {K} AS i, (col + {shift}) // {K} AS j, row AS pr, col AS pc, acc FROM fa
        QUALIFY row_number() OVER (PARTITION BY (row + {shift}) // {K}, (col + {shift}) // {K} ORDER BY acc DESC, pow({lr} - 1.5, 2) + pow({lc} - 1.5, 2), {lr}, {lc}) = 1)"""


_DMM = f"""{_central('a0', 0)}, {_central('b', 2)}, a AS (SELECT * FROM a0 WHERE i < {TOP} // {K} AND j < {WIDTH} // {K}),
    aim AS (SELECT a.i, a.j, a.acc, b.pr // {K} AS di, b.pc // {K} AS dj FROM a LEFT JOIN b ON b.i = (a.pr + 2) // {K} AND b.j = (a.pc + 2) // {K}),
    climb AS (SELECT a.i, a.j, n.code FROM a CROSS JOIN n8 n JOIN a o ON o.i = a.i + n.dr AND o.j = a.j + n.dc WHERE o.acc > a.acc QUALIFY row_number() OVER (PARTITION BY a.i, a.j ORDER BY o.acc DESC, n.idx) = 1)
    SELECT aim.i::INTEGER AS row, aim.j::INTEGER AS col, coalesce(CASE WHEN di = aim.i AND dj = aim.j THEN climb.code WHEN o.acc > aim.acc THEN n8.code END, 0)::INTEGER AS dir
    FROM aim LEFT JOIN climb USING (i, j) LEFT JOIN n8 ON n8.dr = di - aim.i AND n8.dc = dj - aim.j LEFT JOIN a o ON o.i = di AND o.j = dj"""
_TRACE = f"""outl AS (SELECT row // {K} AS i, col // {K} AS j, cell, acc FROM fa QUALIFY row_number() OVER (PARTITION BY row // {K}, col // {K} ORDER BY acc DESC, row, col) = 1),
    fx AS (SELECT e.cell, e.p, (e.p // {WIDTH}) // {K} AS pi, (e.p % {WIDTH}) // {K} AS pj, a.acc AS acc, o.cell IS NOT NULL AS is_out FROM e JOIN acc a ON a.cell = e.p LEFT JOIN outl o ON o.cell = e.p),
    tr(i, j, a0, cell, step, over) AS (SELECT i, j, acc, cell, 0, false FROM outl
        UNION ALL SELECT t.i, t.j, t.a0, fx.p, t.step + 1, fx.is_out AND fx.acc > t.a0 FROM tr t JOIN fx ON fx.cell = t.cell WHERE NOT t.over AND abs(fx.pi - t.i) <= 1 AND abs(fx.pj - t.j) <= 1),
    fin AS (SELECT i, j, max_by(cell, step) AS cell FROM tr GROUP BY i, j)
    SELECT fin.i::INTEGER AS row, fin.j::INTEGER AS col, coalesce(code, 0)::INTEGER AS dir FROM fin LEFT JOIN n8 ON dr = (cell // {WIDTH}) // {K} - i AND dc = (cell % {WIDTH}) // {K} - j"""


#: Outlets with an upstream path in their block longer than 2, or that drain most of it, in place of the largest pixels.
_LONG = _TRACE.replace("outl AS", "largest AS", 1).replace(
    ",\n    fx AS",
    f""",
    px AS (SELECT c.cell, c.row, c.col, c.row // {K} AS i, c.col // {K} AS j, acc.acc, e.p, coalesce((c.row + dr) // {K} <> c.row // {K} OR (c.col + dc) // {K} <> c.col // {K} OR c.row + dr < 0 OR c.col + dc < 0, false) AS leaves
        FROM cells c JOIN acc USING (cell) LEFT JOIN e USING (cell) LEFT JOIN n8 ON n8.code = c.dir),
    fl(cell, spot) AS (SELECT cell, cell FROM px UNION ALL SELECT fl.cell, px.p FROM fl JOIN px ON px.cell = fl.spot WHERE NOT px.leaves AND px.p IS NOT NULL),
    dn AS (SELECT px.i, px.j, px.cell, count(*) AS n FROM fl JOIN px ON px.cell = fl.spot WHERE px.leaves GROUP BY ALL),
    most AS (SELECT i, j, cell FROM dn QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY n DESC, cell) = 1),
    hv AS (SELECT a.p AS cell, a.cell AS up, n8.dist FROM px a JOIN px b ON b.cell = a.p JOIN n8 ON n8.dr = a.row - b.row AND n8.dc = a.col - b.col WHERE NOT a.leaves QUALIFY row_number() OVER (PARTITION BY a.p ORDER BY a.acc DESC, n8.idx) = 1),
    pa(x, spot, far, step) AS (SELECT cell, cell, 0::DOUBLE, 0 FROM px WHERE leaves UNION ALL SELECT x, hv.up, far + hv.dist, step + 1 FROM pa JOIN hv ON hv.cell = pa.spot WHERE step < {K * K}),
    way AS (SELECT x AS cell, max(far) AS far FROM pa GROUP BY x),
    chosen AS (SELECT px.i, px.j, px.cell FROM px JOIN way USING (cell) LEFT JOIN most USING (cell) WHERE far > 2 OR most.cell IS NOT NULL QUALIFY row_number() OVER (PARTITION BY px.i, px.j ORDER BY px.acc DESC, px.cell) = 1),
    outl AS (SELECT l.i, l.j, o.cell, o.acc FROM largest l JOIN px ON px.cell = l.cell LEFT JOIN chosen c ON c.i = l.i AND c.j = l.j JOIN px o ON o.cell = CASE WHEN px.leaves THEN coalesce(c.cell, l.cell) ELSE l.cell END),
    fx AS""",
    1,
)
_THRESHOLD = _TRACE.replace("fx.acc > t.a0", "fx.acc - t.a0 > 6")


def _crossed(rules, width: int, q: str, d: str) -> tuple[str, str, str]:
    """(condition, loser, code) of rule q mod 4 in window q div 4 of the list d of directions; the windows go row by row."""
    at = f"(({q} // 4) // {width - 1} * {width} + ({q} // 4) % {width - 1})"

    def pick(values) -> str:
        return f"([{', '.join(map(str, values))}])[{q} % 4 + 1]"

    def cell_of(place: int) -> str:
        return f"({at} + {pick([r[place][0] * width + r[place][1] for r in rules])} + 1)"

    hit = f"{d}[{cell_of(0)}] = {pick([r[1] for r in rules])} AND {d}[{cell_of(2)}] = {pick([r[3] for r in rules])}"
    loser = f"CASE WHEN h[{cell_of(4)}] > h[{cell_of(5)}] THEN {cell_of(6)} ELSE {cell_of(7)} END"
    return hit, loser, pick([r[8] for r in rules])


def _put(d: str, at: str, code: str) -> str:
    return f"{d}[:{at} - 1] || [({code})::INTEGER] || {d}[{at} + 1:]"


def _cells_of(base: str, heights: str) -> str:
    return f"base AS ({base}), grid AS (SELECT list(base.dir ORDER BY base.row, base.col) AS d, list(t.h ORDER BY base.row, base.col) AS h, max(base.row) + 1 AS nrows FROM base JOIN ({heights}) t USING (row, col))"


def _repaired_cotat(trace: str) -> str:
    """One ordered scan for crossings: each step of the recursion rewrites the next window in conflict."""
    hit, loser, code = _crossed(COTAT_CROSSINGS, _CW, "q", "d")
    return f"""{_cells_of(trace[trace.rindex("SELECT fin.i"):], "SELECT i AS row, j AS col, acc AS h FROM outl")},
        scan(n, d) AS (SELECT 0::BIGINT, d FROM grid
            UNION ALL SELECT q + 1, {_put('d', 'l', 'c')} FROM (SELECT d, q, {loser} AS l, {code} AS c FROM (SELECT *, list_filter(range(n, (nrows - 1) * {_CW - 1} * 4), lambda q: {hit})[1] AS q FROM (SELECT s.*, grid.h, nrows FROM scan s, grid)) WHERE q IS NOT NULL))
        SELECT (k // {_CW})::INTEGER AS row, (k % {_CW})::INTEGER AS col, d[k + 1]::INTEGER AS dir FROM (SELECT d, unnest(range(len(d))) AS k FROM scan WHERE n = (SELECT max(n) FROM scan))"""


def _repaired_dmm() -> str:
    """Counter-flows, four passes over crossings and four over small rings, in order; a step rewrites the next conflict or begins the next pass."""
    w = WIDTH // K
    crossed, loser, code = _crossed(DMM_CROSSINGS, w, "q", "d")
    at = f"((q // 4) // {w - 1} * {w} + (q // 4) % {w - 1})"
    step = {c: dr * w + dc for c, dr, dc in STEPS}
    other = f"({at} + ([{', '.join(str(r * w + c) for _, (r, c), _ in COUNTER)}])[q % 4 + 1])"
    opposed = f"{other} >= 0 AND d[{at} + 1] = ([{', '.join(str(x) for x, _, _ in COUNTER)}])[q % 4 + 1] AND d[{other} + 1] = ([{', '.join(str(y) for _, _, y in COUNTER)}])[q % 4 + 1]"
    weaker = f"CASE WHEN h[{at} + 1] > h[{other} + 1] THEN {at} + 1 ELSE {other} + 1 END"
    inside = " ".join(f"WHEN {c} THEN CASE WHEN c // {w} + {dr} BETWEEN 0 AND nrows - 1 AND c % {w} + {dc} BETWEEN 0 AND {w - 1} THEN c + {step[c]} END" for c, dr, dc in STEPS)
    path = ["q"]
    for _ in range(9):
        path.append(f"nx[{path[-1]} + 1]")
    rings = []
    for i in range(8):
        for size in (2, 3, 4):
            if i + size <= 9:
                ring = path[i : i + size]
                rows, cols = ([f"{p} {op} {w}" for p in ring] for op in ("//", "%"))
                near = " AND ".join(f"greatest({', '.join(x)}) - least({', '.join(x)}) <= 1" for x in (rows, cols)) if size == 4 else "true"
                rings.append((f"{path[i]} = {path[i + size]} AND {near}", f"[{', '.join(ring)}]"))
    ringed = "d[q + 1] <> 0 AND (" + " OR ".join(f"({c})" for c, _ in rings) + ")"
    ring = "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in rings) + " END"
    found = f"list_filter(range(n, CASE WHEN phase < 5 THEN (nrows - 1) * {w - 1} * 4 ELSE len(d) END), lambda q: CASE WHEN phase = 0 THEN {opposed} WHEN phase < 5 THEN {crossed} ELSE {ringed} END)[1]"
    lost = f"CASE WHEN phase = 0 THEN {weaker} WHEN phase < 5 THEN {loser} ELSE list_filter({ring}, lambda c: h[c + 1] = list_min(list_transform({ring}, lambda x: h[x + 1])))[1] + 1 END"
    return f"""{_cells_of(_DMM[_DMM.rindex("SELECT aim.i"):], "SELECT i AS row, j AS col, acc AS h FROM a")},
        scan(phase, n, d) AS (SELECT 0, 0::BIGINT, d FROM grid
            UNION ALL SELECT CASE WHEN q IS NULL THEN phase + 1 ELSE phase END, CASE WHEN q IS NULL THEN 0 ELSE q + 1 END, CASE WHEN q IS NULL THEN d ELSE {_put('d', 'l', 'c')} END
            FROM (SELECT phase, d, q, {lost} AS l, CASE WHEN phase BETWEEN 1 AND 4 THEN {code} ELSE 0 END AS c FROM (SELECT *, {found} AS q FROM (
                SELECT s.*, grid.h, nrows, list_transform(range(len(s.d)), lambda c: CASE s.d[c + 1] {inside} END) AS nx FROM scan s, grid WHERE phase < 9))))
        SELECT (k // {w})::INTEGER AS row, (k % {w})::INTEGER AS col, d[k + 1]::INTEGER AS dir FROM (SELECT d, unnest(range(len(d))) AS k FROM scan WHERE phase = 9)"""


#: Place of an inflow, from north-west row by row, by its direction.
_PLACES = {2: 0, 4: 1, 8: 2, 1: 3, 16: 4, 128: 5, 64: 6, 32: 7}


def _steepest() -> str:
    """The directions d of the grid by windows along rows and columns, without joins."""
    order = [("v1", 1), ("v2", 2), ("v4", 4), ("v8", 8), ("v16", 16), ("v32", 32), ("v64", 64), ("v128", 128)]
    slopes = ", ".join(f"(z - {v}) / {'1.0::DOUBLE' if c in (1, 4, 16, 64) else 'sqrt(2.0::DOUBLE)'}" for v, c in order)
    return f"""{_grid()}, along AS (SELECT *, lag(z) OVER r AS v16, lead(z) OVER r AS v1 FROM g WINDOW r AS (PARTITION BY row ORDER BY col)),
        across AS (SELECT *, lag(v16) OVER c AS v32, lag(z) OVER c AS v64, lag(v1) OVER c AS v128, lead(v16) OVER c AS v8, lead(z) OVER c AS v4, lead(v1) OVER c AS v2 FROM along WINDOW c AS (PARTITION BY col ORDER BY row)),
        steep AS (SELECT row, col, list_transform([{slopes}], lambda x: coalesce(x, 0)) AS s FROM across),
        d AS (SELECT row, col, CASE WHEN list_max(s) > 0 THEN (1 << (list_position(s, list_max(s)) - 1)) ELSE 0 END::INTEGER AS dir FROM steep)"""


def oracle_sql() -> dict[str, str]:
    steep = {"tilt": 200_000.0}
    area = f"pow(6371000.0::DOUBLE, 2) * radians(0.01) * radians(0.01) / 1e6 * cos(radians({_y('row')}))"
    best = "(SELECT cell FROM fa ORDER BY acc DESC, cell LIMIT 1)"
    flat_mask = "SELECT row, col, coalesce({x}, false) AS m FROM {t}"
    return {
        "flagship": _with(_counts(), "SELECT fd.row, fd.col, fd.dir, fa.acc FROM fd JOIN fa USING (row, col)"),
        "d8_planar": _with(_fd(), "SELECT row, col, dir FROM fd"),
        "d8_holes": _with(_fd(holes=True), "SELECT row, col, dir FROM fd"),
        "d8_spherical": _with(_fd(sphere=True), "SELECT row, col, dir FROM fd"),
        "receivers": _with(_fd(holes=True), "SELECT cells.cell, e.p FROM cells LEFT JOIN e USING (cell)"),
        "in_degree": _with(_fd(), "SELECT row, col, count(e.cell)::BIGINT AS n FROM cells LEFT JOIN e ON e.p = cells.cell GROUP BY row, col"),
        "upstream_neighbours": "WITH "
        + _steepest()
        + """, n8(code, dr, dc, place) AS (VALUES """
        + ", ".join(f"({c}, {dr}, {dc}, {_PLACES[c]})" for c, dr, dc in STEPS)
        + """) SELECT (d.row + dr)::INTEGER AS row, (d.col + dc)::INTEGER AS col, d.row AS up_row, d.col AS up_col, place::INTEGER AS place FROM d JOIN n8 ON code = dir""",
        "cell_area": _with(_grid(), f"SELECT row, col, round({area}, 6) AS area FROM g"),
        "row_distances": _with(f"{N8}, {_grid()}, a AS (SELECT DISTINCT row FROM g)", f"SELECT a.row, n.code::INTEGER AS code, round({_FAR}, 4) AS distance FROM a CROSS JOIN n8 n"),
        "flow_accumulation_count": _with(_counts(), "SELECT row, col, acc FROM fa"),
        "flow_accumulation_holes": _with(_counts(holes=True), "SELECT row, col, acc FROM fa"),
        "flow_accumulation_steep": _with(_counts(**steep), "SELECT row, col, acc FROM fa"),
        "flow_accumulation_area": _with(
            f"{_fd(sphere=True)}, {_UP}, w AS (SELECT cell, {area} AS w FROM cells)", f"SELECT (anc // {WIDTH})::INTEGER AS row, (anc % {WIDTH})::INTEGER AS col, round(sum(w), 6) AS acc FROM up JOIN w USING (cell) GROUP BY anc"
        ),
        "watershed": _with(f"{_counts()}, basin AS (SELECT cell FROM up WHERE anc = {best})", "SELECT row, col, cell IN (SELECT cell FROM basin) AS m FROM cells"),
        "strahler": _with(f"{_fd(**steep)}, {_STRAHLER}", "SELECT row, col, ord FROM st"),
        "snap": _with(_counts(), "SELECT row, col, acc FROM fa WHERE pow(col + 0.5 - 50, 2) + pow(-row - 0.5 + 6, 2) <= 20.25 ORDER BY acc DESC, row, col LIMIT 1"),
        "threshold_mask": _with(_counts(), flat_mask.format(x="acc >= 5", t="fa")),
        "threshold_mask_strahler": _with(f"{_fd(**steep)}, {_STRAHLER}", flat_mask.format(x="ord >= 2", t="st")),
        "mask_grid": _with(_counts(), "SELECT row, col, CASE WHEN acc >= 5 THEN acc END AS acc FROM fa"),
        "mask_area": _with(_grid(), f"SELECT round(sum({area}), 3) AS area FROM g WHERE {_STRIPES}"),
        "disaggregate_mask": _with(_PART, "SELECT (row * 3 + i)::INTEGER AS row, (col * 3 + j)::INTEGER AS col, acc >= 25 AS m FROM pg, range(3) a(i), range(3) b(j)"),
        "match_grids": _with(f"{_grid()}, {_PART}", "SELECT g.row, g.col, pg.acc FROM g LEFT JOIN pg USING (row, col)"),
        "crop_grid": _with(
            f"{_PART}, t AS (SELECT row, col, CASE WHEN col BETWEEN 7 AND 60 AND acc > 10 THEN acc END AS acc FROM pg), b AS (SELECT min(row) r0, max(row) r1, min(col) c0, max(col) c1 FROM t WHERE acc IS NOT NULL)",
            "SELECT row - r0 AS row, col - c0 AS col, acc, r1 - r0 + 1 AS nrows, c1 - c0 + 1 AS ncols FROM t, b WHERE row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1",
        ),
        "compare_watersheds": _with(
            f"{_counts(**steep)}, x AS (SELECT acc >= 4 AS a, {_STRIPES} AS b FROM fa)",
            "SELECT round(sum((a AND b)::INTEGER)::DOUBLE * sum((a AND b)::INTEGER) / (sum(a::INTEGER) * sum(b::INTEGER)), 6) AS ochiai2, sum(a::INTEGER)::DOUBLE AS area_1, sum(b::INTEGER)::DOUBLE AS area_2, sum((a AND b)::INTEGER)::DOUBLE AS area_both FROM x",
        ),
        "windrose_count": _with(f"{_fd()}, {_rose('rose', '(fd.dir IS NOT NULL)::INTEGER')}", "SELECT bin::INTEGER AS bin, dir::INTEGER AS dir, total, round(total / sum(total) OVER (), 6) AS share FROM rose"),
        "windrose_metres": _with(
            f"{_fd(sphere=True)}, far AS (SELECT a.row, n.code, {_FAR} AS d FROM (SELECT DISTINCT row FROM g) a CROSS JOIN n8 n), rose AS (SELECT idx AS bin, n8.code AS dir, coalesce(sum(far.d), 0)::DOUBLE AS total FROM n8 LEFT JOIN fd ON fd.dir = n8.code LEFT JOIN far ON far.row = fd.row AND far.code = n8.code GROUP BY idx, n8.code)",
            "SELECT bin::INTEGER AS bin, dir::INTEGER AS dir, round(total, 3) AS total, round(total / sum(total) OVER (), 3) AS share FROM rose",
        ),
        "nsa_4": _with(f"{_counts()}, {_block(4)}", "SELECT row, col, dir FROM nsa"),
        "nsa_8": _with(f"{_counts()}, {_block(8)}", "SELECT row, col, dir FROM nsa"),
        "dmm_assign": _with(f"{_counts()}, {_DMM}", ""),
        "cotat_trace": _with(f"{_counts()}, {_TRACE}", ""),
        "dmm": _with(f"{_counts()}, {_DMM[: _DMM.rindex('SELECT aim.i')].rstrip()}, {_repaired_dmm()}", ""),
        "cotat": _with(f"{_counts()}, {_TRACE[: _TRACE.rindex('SELECT fin.i')].rstrip()}, {_repaired_cotat(_TRACE)}", ""),
        "cotat_threshold": _with(f"{_counts()}, {_THRESHOLD[: _THRESHOLD.rindex('SELECT fin.i')].rstrip()}, {_repaired_cotat(_THRESHOLD)}", ""),
        "cotat_mufp": _with(f"{_counts()}, {_LONG[: _LONG.rindex('SELECT fin.i')].rstrip()}, {_repaired_cotat(_LONG)}", ""),
        "huac": _with(
            f"""{_counts()}, {_block(K)}, {_COARSE}, cup(cell, anc) AS (SELECT cell, cell FROM cc UNION ALL SELECT cup.cell, ce.p FROM cup JOIN ce ON cup.anc = ce.cell),
            ca AS (SELECT anc AS cell, count(*)::DOUBLE AS acc FROM cup GROUP BY anc), pour AS (SELECT cell FROM ca ORDER BY acc DESC, cell LIMIT 1),
            fine AS (SELECT row // {K} AS i, col // {K} AS j, row, col, acc FROM fa QUALIFY row_number() OVER (PARTITION BY row // {K}, col // {K} ORDER BY acc DESC, row, col) = 1)""",
            """SELECT cc.row AS cell_row, cc.col AS cell_col, fine.row AS max_pixel_row, fine.col AS max_pixel_col, ca.acc AS coarse_upstream_area, fine.acc::DOUBLE AS fine_max_upstream_area, round((ca.acc - fine.acc) / fine.acc, 6) AS relative_upstream_area_error
            FROM cup JOIN pour ON cup.anc = pour.cell JOIN cc ON cc.cell = cup.cell JOIN ca ON ca.cell = cup.cell LEFT JOIN fine ON fine.i = cc.row AND fine.j = cc.col WHERE ca.acc >= 2""",
        ),
        "river_tree": _with(f"{_counts(**steep)}, {_tree()}", f"SELECT fd.row, fd.col, ids.seed_id AS segment_id FROM fd LEFT JOIN seg ON seg.cell = fd.row * {WIDTH} + fd.col LEFT JOIN ids ON ids.mouth = seg.mouth"),
        "river_tree_seeds": _with(f"{_counts(**steep)}, {_tree()}", _SEEDS),
        "river_tree_masked": _with(f"{_counts(**steep)}, {_tree(True)}", _SEEDS),
        "mask_seeds": _with(
            f"""{_counts(**steep)}, {_tree()}, pts AS (SELECT ids.seed_id, ids.ncells - 1 - steps AS pos, seg.cell, n8.dist FROM ids JOIN seg USING (mouth) JOIN cells c ON c.cell = seg.cell JOIN n8 ON n8.code = c.dir WHERE (c.row + c.col) % 7 < 5),
            isl AS (SELECT *, pos - row_number() OVER (PARTITION BY seed_id ORDER BY pos) AS island FROM pts),
            runs AS (SELECT seed_id AS parent, min(pos) AS pos, min_by(cell, pos) AS head, max_by(cell, pos) AS mouth, count(*)::BIGINT AS ncells, sum(dist) - max_by(dist, pos) AS len FROM isl GROUP BY seed_id, island HAVING count(*) > 1)""",
            f"SELECT row_number() OVER (ORDER BY parent, pos)::BIGINT AS seed_id, (mouth // {WIDTH})::INTEGER AS mouth_row, (mouth % {WIDTH})::INTEGER AS mouth_col, (head // {WIDTH})::INTEGER AS headwater_row, (head % {WIDTH})::INTEGER AS headwater_col, ncells, acc.acc, round(len, 6) AS length_m FROM runs JOIN acc ON acc.cell = mouth",
        ),
        "vectorize_network": _with(
            f"{_counts()}, {_NETWORK}", f"SELECT (head // {WIDTH})::INTEGER AS start_row, (head % {WIDTH})::INTEGER AS start_col, count(*)::BIGINT AS points, {_WKT} AS wkt, max_by(acc, pos)::DOUBLE AS flowacc FROM walk JOIN acc USING (cell) GROUP BY head HAVING count(*) > 1"
        ),
        "vectorize_tree": _with(f"{_counts(**steep)}, {_tree()}, {_lines('')}", ""),
        "vectorize_tree_cutoff": _with(f"{_counts(**steep)}, {_tree()}, {_lines('WHERE acc >= 12')}", ""),
        "vectorize_tree_rank": _with(f"{_counts(**steep)}, {_tree()}, {_lines('WHERE seed_id <= 10')}", ""),
        "compare_flowdir": _with(f"{_counts(**steep)}, {_score(0.0, '<>')}", ""),
        "compare_flowdir_alpha": _with(f"{_counts(**steep)}, {_score(0.5, '<>')}", ""),
        "compare_flowdir_strict": _with(f"{_counts(**steep)}, {_score(0.0, '>')}", ""),
        "compare_flowdir_cascade": _with(f"{_counts(**steep)}, {_score(0.25, '>', cascade=True)}", ""),
        "windrose_emd": _with(
            f"{_fd()}, {_rose('r1', '(fd.dir IS NOT NULL)::INTEGER')}, {_fd(**steep, s='2')}, r2 AS (SELECT idx AS bin, coalesce(sum((fd2.dir IS NOT NULL)::INTEGER), 0)::DOUBLE AS total FROM n8 LEFT JOIN fd2 ON fd2.dir = code GROUP BY idx), "
            "d AS (SELECT r1.bin, r1.total / sum(r1.total) OVER () - r2.total / sum(r2.total) OVER () AS x FROM r1 JOIN r2 USING (bin)), f AS (SELECT sum(x) OVER (ORDER BY bin) AS f FROM d)",
            "SELECT round(least(1, greatest(0, sum(abs(f - (SELECT quantile_cont(f, 0.5) FROM f))) / 4)), 6) AS emd FROM f",
        ),
    }
