import math

import models
import pytest
from grids import dem, directions

from rillflow.model import GridMeta, GridType, from_rows
from rillflow.operators import evaluate, hydrology, masks, neighbours, network, repair, upscale

FLAT = {"crs": "EPSG:32632", "a": 1.0, "e": -1.0}


def grid(spark, rows, type, **kw):
    return from_rows(spark, rows, type, **(FLAT | kw))


@pytest.fixture(scope="module")
def river(spark):
    """(rows of directions, of counts, their grids) of a tilted terrain."""
    fd = models.d8(dem(11, 26, 22))
    acc, _ = models.accumulate(fd)
    return fd, acc, grid(spark, fd, GridType.FlowDir), grid(spark, acc, GridType.FlowAcc)


@pytest.mark.parametrize("seed,levels", [(1, None), (2, 4)])
def test_d8(spark, seed, levels):
    z = dem(seed, 13, 17, levels=levels)
    assert neighbours.d8(grid(spark, z, GridType.DEM)).rows() == models.d8(z)


def test_d8_of_a_sparse_frame(spark):
    z = dem(5, 8, 9, holes=0.3)
    g = grid(spark, z, GridType.DEM)
    assert neighbours.d8(g.with_df(g.df.where("z IS NOT NULL"))).rows() == models.d8(z)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_accumulation_with_cycles(spark, seed):
    fd = directions(seed, 9, 8)
    assert hydrology.flow_accumulation(grid(spark, fd, GridType.FlowDir), area=False).rows() == models.accumulate(fd)[0]


@pytest.mark.parametrize("tile", [3, 5, 64])
@pytest.mark.parametrize("rows", ["river", "rings"])
def test_accumulation_in_tiles(spark, river, rows, tile):
    fd = river[0] if rows == "river" else directions(9, 12, 11, sinks=0.15)
    assert hydrology.flow_accumulation(grid(spark, fd, GridType.FlowDir), area=False, tile=tile).rows() == models.accumulate(fd)[0]


def test_accumulated_area(spark):
    z = dem(3, 10, 10)
    g = from_rows(spark, z, GridType.DEM, a=0.1, e=-0.1, f=48.0)
    fd = neighbours.d8(g)
    area = lambda p: 6371.0**2 * math.radians(0.1) ** 2 * math.cos(math.radians(48 - 0.1 * (p[0] + 0.5)))
    want = models.accumulate(fd.rows(), area)[0]
    got = hydrology.flow_accumulation(fd).rows()
    assert all(a == b or math.isclose(a, b, rel_tol=1e-9) for x, y in zip(got, want) for a, b in zip(x, y))


@pytest.mark.parametrize("seed,tile", [(4, 64), (5, 3), (9, 4)])
def test_watershed(spark, river, seed, tile):
    for fd in (directions(seed, 8, 9), river[0]):
        for pour in ((4, 4), (0, 0), (7, 5)):
            assert hydrology.delineate_watershed(grid(spark, fd, GridType.FlowDir), *pour, tile=tile).rows(False) == models.watershed(fd, pour)
    with pytest.raises(ValueError):
        hydrology.delineate_watershed(grid(spark, directions(seed, 8, 9), GridType.FlowDir), 8, 0)


@pytest.mark.parametrize("rows", ["random", "river"])
def test_strahler(spark, river, rows):
    fd = directions(6, 10, 10) if rows == "random" else river[0]
    assert hydrology.strahler_order(grid(spark, fd, GridType.FlowDir)).rows() == models.strahler(fd)


def test_strahler_hand_made(spark):
    x = None
    fd = [[x] * 6, [x, 1, 4, 1, 4, x], [x, 1, 4, 1, 4, x], [x, x, 1, 4, 16, x], [x, x, x, 4, x, x], [x, x, x, 0, x, x], [x] * 6]
    want = [[x] * 6, [x, 1, 1, 1, 1, x], [x, 1, 2, 1, 2, x], [x, x, 2, 3, 2, x], [x, x, x, 3, x, x], [x] * 6, [x] * 6]
    assert hydrology.strahler_order(grid(spark, fd, GridType.FlowDir)).rows() == want


def seeds_of(df):
    names = ["mouth_row", "mouth_col", "headwater_row", "headwater_col", "ncells", "acc"]
    return [tuple(r[n] for n in names) for r in df.orderBy("seed_id").collect()]


def test_river_tree_and_mask_seeds(spark, river):
    fd, acc, gd, ga = river
    tree, seeds = network.river_tree(gd, ga)
    want_tree, want = models.river_tree(fd, acc)
    assert tree.rows() == want_tree
    assert seeds_of(seeds) == want
    mask = [[(i + j) % 7 < 5 for j in range(22)] for i in range(26)]
    gm = grid(spark, mask, GridType.Mask)
    tree, part = network.river_tree(gd, ga, gm)
    want_tree, want_part = models.river_tree(fd, acc, mask)
    assert tree.rows() == want_tree and seeds_of(part) == want_part
    runs = network.mask_seeds(seeds, gd, ga, gm)
    assert [r[:5] for r in seeds_of(runs)] == models.mask_runs(fd, want, mask)
    with pytest.raises(ValueError):
        network.mask_seeds(seeds.drop("acc"), gd, ga, gm)


@pytest.mark.parametrize("rows", ["random", "river"])
def test_network(spark, river, rows):
    fd = directions(8, 9, 9) if rows == "random" else river[0]
    got = network.vectorize_network(grid(spark, fd, GridType.FlowDir)).collect()
    lines = {(r.start_row, r.start_col): [(int(-p.y - 0.5), int(p.x - 0.5)) for p in r.path] for r in got}
    assert lines == {tuple(p[0]): p for p in models.network(fd)}


def test_vectorize_tree(spark, river):
    fd, acc, gd, ga = river
    _, seeds = network.river_tree(gd, ga)
    seeds = seeds.cache()
    for r in network.vectorize_tree(seeds, gd).join(seeds, "seed_id").collect():
        path = [(int(-p.y - 0.5), int(p.x - 0.5)) for p in r.path]
        assert path[0] == (r.headwater_row, r.headwater_col) and path[r.ncells - 1] == (r.mouth_row, r.mouth_col)
        below = models.to(fd, path[r.ncells - 1])
        assert path[r.ncells :] == ([below] if below else [])
    top = network.vectorize_tree(seeds, gd, rank=3)
    assert sorted((r.flowacc for r in top.collect()), reverse=True) == sorted((float(s[5]) for s in seeds_of(seeds)), reverse=True)[:3]
    assert network.vectorize_tree(seeds, gd, cutoff=30).count() == sum(s[5] >= 30 for s in seeds_of(seeds))
    with pytest.raises(ValueError):
        network.vectorize_tree(seeds, gd, cutoff=1, rank=1)


@pytest.mark.parametrize("k", [3, 4])
def test_nsa(river, k):
    assert upscale.NSA(river[3], k).rows() == models.nsa(river[1], k)


@pytest.mark.parametrize("seed,k", [(11, 2), (12, 4), (13, 2)])
def test_dmm(spark, seed, k):
    acc, _ = models.accumulate(models.d8(dem(seed, 33, 30)))
    g = grid(spark, acc, GridType.FlowAcc)
    assert upscale.dmm_assigned(g, k)[0].rows() == models.dmm_assigned(acc, k)[0]
    assert upscale.DMM(g, k).rows() == models.dmm(acc, k, repair.DMM_CROSSINGS)
    with pytest.raises(ValueError):
        upscale.DMM(g, 3)


def noisy(seed, n, k):
    """Accumulations of noise: many conflicts on the coarse grid."""
    import random

    r = random.Random(seed)
    return [[r.randrange(1000) for _ in range(n * k)] for _ in range(n * k)]


def test_repair_of_many_conflicts(spark):
    acc = noisy(3, 24, 2)
    want = models.dmm(acc, 2, repair.DMM_CROSSINGS)
    assert want != models.dmm_assigned(acc, 2)[0]
    assert upscale.DMM(grid(spark, acc, GridType.FlowAcc), 2).rows() == want


@pytest.mark.parametrize("threshold,mufp", [(0, None), (9, None), (0, 2.5), (0, 0.0)])
def test_cotat(river, threshold, mufp):
    fd, acc, gd, ga = river
    metres = lambda a, b: math.dist(a, b)
    want = models.cotat(fd, acc, 4, repair.COTAT_CROSSINGS, threshold, mufp, metres)
    assert upscale.COTAT(gd, ga, 4, area_threshold=threshold, mufp=mufp).rows() == want


def test_cotat_in_small_tiles(river, monkeypatch):
    fd, acc, gd, ga = river
    want = models.cotat(fd, acc, 3, ())
    got = upscale.cotat_traced(gd, ga, 3, 0, None, tile=6)[0].rows()
    assert got == want


@pytest.mark.parametrize("options", [{}, {"alpha": 0.5}, {"strict": True}, {"cascade": True, "alpha": 0.25}])
def test_compare_flowdir(spark, river, options):
    fd, acc, gd, ga = river
    _, seeds = network.river_tree(gd, ga)
    coarse = models.dmm(acc, 2, repair.DMM_CROSSINGS)
    gc = grid(spark, coarse, GridType.FlowDir, a=2.0, e=-2.0)
    names = {"strict": "strict_upstream"}
    got = evaluate.compare_flowdir(gd, gc, seeds, **{names.get(k, k): v for k, v in options.items()})
    want = models.compare(fd, coarse, seeds_of(seeds), 2, options.get("alpha", 0.0), options.get("strict", False), options.get("cascade", False))
    assert [r.score for r in got.orderBy("seed_id").collect()] == pytest.approx(want, abs=1e-6)
    with pytest.raises(TypeError):
        evaluate.compare_flowdir(gd, gc, seeds.drop("acc"))


def test_huac(spark, river):
    fd, acc, gd, ga = river
    coarse = models.nsa(acc, 2)
    cacc = models.accumulate(coarse)[0]
    pour = max(models.cells(coarse), key=lambda p: models.at(cacc, p) or 0)
    gc, gca = grid(spark, coarse, GridType.FlowDir, a=2.0, e=-2.0), grid(spark, cacc, GridType.FlowAcc, a=2.0, e=-2.0)
    errors, table = hydrology.huac(ga, gc, gca, *pour, upstream_area_threshold=3)
    basin = models.watershed(coarse, pour)
    want = {}
    for p in models.cells(coarse):
        if models.at(basin, p) and models.at(cacc, p) >= 3:
            top = models.block_max(acc, *p, 2)
            want[p] = (models.at(cacc, p), top, (models.at(cacc, p) - top) / top)
    assert {(r.cell_row, r.cell_col): (r.coarse_upstream_area, r.fine_max_upstream_area, r.relative_upstream_area_error) for r in table.collect()} == want
    assert errors.type is GridType.FlowAcc


def test_windrose_and_distance(spark, river):
    fd, _, gd, _ = river
    rose = evaluate.flowdir_windrose(gd, dist=False)
    want = [sum(d == c for r in fd for d in r) for c in models.CODES]
    assert [r.total for r in rose.orderBy("bin").collect()] == want
    metres = [r.total for r in evaluate.flowdir_windrose(gd).orderBy("bin").collect()]
    assert metres == pytest.approx([n * math.hypot(*models.STEP[c]) for n, c in zip(want, models.CODES)])
    one = spark.createDataFrame([(i, float(i == 0)) for i in range(8)], "bin int, share double")
    four = spark.createDataFrame([(i, float(i == 4)) for i in range(8)], "bin int, share double")
    assert evaluate.windrose_emd(one, four).first().emd == 1.0
    assert evaluate.windrose_emd(one, one).first().emd == 0.0
    assert evaluate.windrose_emd(rose, one).first().emd == pytest.approx(evaluate.windrose_emd(one, rose).first().emd)
    with pytest.raises(ValueError):
        evaluate.windrose_emd(one, one.where("bin < 7"))


def test_degree_and_upstream(spark, river):
    fd, _, gd, _ = river
    want = {}
    for p in models.cells(fd):
        s = models.STEP.get(models.at(fd, p))
        q = s and (p[0] + s[0], p[1] + s[1])
        if q and 0 <= q[0] < 26 and 0 <= q[1] < 22:
            want.setdefault(q, set()).add(p)
    assert {(r.row, r.col): r.n for r in neighbours.in_degree(gd).collect() if r.n} == {q: len(ps) for q, ps in want.items()}
    got = {}
    for r in neighbours.upstream_neighbours(gd).collect():
        got.setdefault((r.row, r.col), {})[r.place] = (r.up_row, r.up_col)
    assert {q: list(ps[i] for i in sorted(ps)) for q, ps in got.items()} == {q: sorted(ps) for q, ps in want.items()}


def test_masks(spark):
    x = None
    acc = grid(spark, [[x, 5, 10], [1, 2, 3]], GridType.FlowAcc)
    on = masks.threshold_mask(acc, 5)
    assert on.rows() == [[False, True, True], [False, False, False]]
    assert masks.threshold_mask(grid(spark, [[x, 1, 2]], GridType.Strahler), 0).rows() == [[False, True, True]]
    assert masks.mask_grid(acc, on).rows() == [[x, 5, 10], [x, x, x]]
    assert masks.mask_area(on).first().area == 2.0
    fine = masks.disaggregate_mask(on, 2)
    assert fine.shape == (4, 6) and fine.meta.a == 0.5 and sum(map(sum, fine.rows())) == 8
    row, _ = masks.compare_watersheds(on, on)
    assert row.first().ochiai2 == 1.0
    other = grid(spark, [[False, True, False], [True, False, False]], GridType.Mask)
    row, common = masks.compare_watersheds(on, other)
    assert row.first().ochiai2 == 0.25 and common.rows() == [[False, True, False], [False] * 3]
    with pytest.raises(ValueError, match="disaggregate"):
        masks.compare_watersheds(on, fine)
    with pytest.raises(ValueError):
        masks.threshold_mask(on, 1)
    with pytest.raises(ValueError):
        masks.disaggregate_mask(on, 0)


def test_crop_and_match(spark):
    x = None
    g = grid(spark, [[x] * 5, [x, x, 7, 7, x], [x, x, 7, x, x], [x] * 5], GridType.FlowAcc, c=10.0, f=50.0)
    c = masks.crop_grid(g)
    assert c.rows() == [[7, 7], [7, x]] and (c.meta.c, c.meta.f) == (12.0, 49.0)
    assert masks.crop_grid(c) is c
    assert masks.match_grids(g, c).rows() == g.rows()
    with pytest.raises(ValueError):
        masks.crop_grid(grid(spark, [[x, x]], GridType.FlowAcc))
    with pytest.raises(ValueError):
        masks.match_grids(c, g)


def test_snap(spark):
    fa = from_rows(spark, [[1, 9, 3], [9, 2, 8], [None, 4, 10]], GridType.FlowAcc, f=3.0)
    assert hydrology.snap_pour_cell(fa, 1.5, 1.5, 1.0) == (0, 1)
    assert hydrology.snap_pour_cell(fa, 1.5, 1.5, 2.0) == (2, 2)
    with pytest.raises(ValueError):
        hydrology.snap_pour_cell(fa, 0.5, 0.5, 0.2)


def test_alignment():
    from rillflow.model import check_aligned

    fine = GridMeta(16, 16)
    assert check_aligned(fine, GridMeta(4, 4, a=4.0, e=-4.0)) == (4, 4, 0, 0)
    assert check_aligned(fine, GridMeta(3, 3, a=4.0, e=-4.0, c=2.0, f=-2.0)) == (4, 4, 2, 2)
    for bad in ({"a": 3.5, "e": -3.5}, {"a": 4.0, "e": -4.0, "c": 0.5}, {"a": 4.0, "e": -4.0, "c": -4.0}):
        with pytest.raises(ValueError):
            check_aligned(fine, GridMeta(3, 3, **bad))


def test_types(spark):
    g = from_rows(spark, [[1, 255, 0]], GridType.FlowDir)
    assert g.rows() == [[1, None, 0]]
    assert from_rows(spark, [[2.0, float("nan")]], GridType.DEM).rows() == [[2.0, None]]
    assert from_rows(spark, [[0, 3]], GridType.Mask, "int").rows() == [[False, True]]
    with pytest.raises(TypeError):
        from_rows(spark, [["a"]], GridType.DEM, "string")
