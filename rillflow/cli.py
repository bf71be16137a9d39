"""Command line: ``python -m rillflow.cli VERB ...``, or the same through spark-submit.

Paths ending in .tif, .asc, .npz, .npy, .csv and .gpkg are files; others are Parquet folders.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .model import GridType
from .operators import evaluate, hydrology, masks, neighbours, network, upscale
from .sources import lines, rasters

DIR, ACC, MASK, DEM = GridType.FlowDir, GridType.FlowAcc, GridType.Mask, GridType.DEM


def grid_type(name: str) -> GridType:
    found = {t.value.lower(): t for t in GridType}.get(name.lower())
    if found is None:
        raise argparse.ArgumentTypeError(f"unknown grid type {name!r}")
    return found


def path(name: str, required: bool = True, **kw) -> tuple[tuple, dict]:
    return (f"--{name}",), {"required": required} | kw


OUT = (("-o", "--output"), {"required": True})
FACTOR = (("-k",), {"type": int, "required": True})
NUMBER = {"type": float}
POUR = [path("x", **NUMBER), path("y", **NUMBER), path("radius", **NUMBER)]
FLAG = {"action": "store_true"}
#: Verbs with their options.
VERBS = {
    "dmm": [path("flowacc"), OUT, FACTOR],
    "nsa": [path("flowacc"), OUT, FACTOR],
    "cotat": [path("flowdir"), path("flowacc"), OUT, FACTOR, path("area-threshold", False, default=0.0, **NUMBER), path("mufp", False, **NUMBER)],
    "d8": [path("dem"), OUT, (("--spherical",), {"action": argparse.BooleanOptionalAction, "default": True})],
    "flowacc": [path("flowdir"), OUT, (("--cells",), FLAG)],
    "watershed": [path("flowdir"), *POUR, OUT, path("flowacc", False)],
    "huac": [path("flowacc-fine"), path("flowdir-coarse"), path("flowacc-coarse"), *POUR, (("-o-raster", "--o-raster"), {"required": True}), (("-o-csv", "--o-csv"), {"required": True}), path("upstream-area-threshold", False, default=0.0, **NUMBER)],
    "compare-watersheds": [path("mask1"), path("mask2"), (("-o", "--output"), {})],
    "compare-flowdir": [path("flowdir-fine"), path("flowdir-coarse"), path("seeds"), OUT, path("alpha", False, default=0.0, **NUMBER), (("--no-shuffle",), FLAG), (("--strict-upstream",), FLAG), (("--cascade",), FLAG)],
    "river-tree": [path("flowdir"), path("flowacc"), path("mask", False), path("o-tree"), path("o-seeds")],
    "strahler": [path("flowdir"), OUT],
    "mask-seeds": [path("seeds"), path("flowdir"), path("flowacc"), path("mask"), OUT],
    "threshold-mask": [path("cutoff", **NUMBER), OUT],
    "mask-grid": [path("grid"), path("grid-type", type=grid_type), path("mask"), OUT],
    "crop-grid": [path("grid"), path("grid-type", type=grid_type), OUT],
    "vectorize-network": [path("flowdir"), path("flowacc", False), OUT],
    "vectorize-tree": [path("seeds"), path("flowdir"), path("cutoff", False, **NUMBER), path("rank", False, type=int), path("accuracy", False), OUT],
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rillflow", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    for name, options in VERBS.items():
        own = verbs.add_parser(name)
        for flags, how in options:
            own.add_argument(*flags, **how)
        if name == "threshold-mask":
            either = own.add_mutually_exclusive_group(required=True)
            either.add_argument("--flowacc")
            either.add_argument("--strahler")
    return top


def pour_cell(meta, x: float, y: float) -> tuple[int, int]:
    """The cell of a point; halves round to even. ValueError outside the grid."""
    row, col = round((y - meta.f) / meta.e - 0.5), round((x - meta.c) / meta.a - 0.5)
    if not (0 <= row < meta.nrows and 0 <= col < meta.ncols):
        raise ValueError(f"({x}, {y}) lies outside the grid; give --flowacc to snap")
    return row, col


def run(a: argparse.Namespace, spark: SparkSession) -> None:
    def get(name: str, kind: GridType):
        return rasters.read(spark, getattr(a, name), kind)

    def put(grid, to: str | None = None) -> None:
        rasters.write(grid, to or a.output, overwrite=True)

    match a.verb:
        case "dmm":
            put(upscale.DMM(get("flowacc", ACC), a.k))
        case "nsa":
            put(upscale.NSA(get("flowacc", ACC), a.k))
        case "cotat":
            put(upscale.COTAT(get("flowdir", DIR), get("flowacc", ACC), a.k, area_threshold=a.area_threshold, mufp=a.mufp))
        case "d8":
            put(neighbours.d8(get("dem", DEM), a.spherical))
        case "flowacc":
            put(hydrology.flow_accumulation(get("flowdir", DIR), area=not a.cells))
        case "watershed":
            fd = get("flowdir", DIR)
            pour = hydrology.snap_pour_cell(get("flowacc", ACC), a.x, a.y, a.radius) if a.flowacc else pour_cell(fd.meta, a.x, a.y)
            put(hydrology.delineate_watershed(fd, *pour))
        case "huac":
            coarse = get("flowacc_coarse", ACC)
            errors, table = hydrology.huac(get("flowacc_fine", ACC), get("flowdir_coarse", DIR), coarse, *hydrology.snap_pour_cell(coarse, a.x, a.y, a.radius), upstream_area_threshold=a.upstream_area_threshold)
            put(errors, a.o_raster)
            if a.o_csv.lower().endswith(".csv"):
                table.toPandas().to_csv(a.o_csv, index=False)
            else:
                table.write.mode("overwrite").csv(a.o_csv, header=True)
        case "compare-watersheds":
            score, common = masks.compare_watersheds(get("mask1", MASK), get("mask2", MASK))
            print(f"{score.first().ochiai2:.4f}")
            if a.output:
                put(common)
        case "compare-flowdir":
            scores = evaluate.compare_flowdir(get("flowdir_fine", DIR), get("flowdir_coarse", DIR), rasters.read_seeds(spark, a.seeds), alpha=a.alpha, strict_upstream=a.strict_upstream, cascade=a.cascade)
            rasters.write_scores(scores, a.output)
        case "river-tree":
            tree, seeds = network.river_tree(get("flowdir", DIR), get("flowacc", ACC), get("mask", MASK) if a.mask else None)
            put(tree, a.o_tree)
            rasters.write_seeds(seeds, a.o_seeds)
        case "strahler":
            put(hydrology.strahler_order(get("flowdir", DIR)))
        case "mask-seeds":
            rasters.write_seeds(network.mask_seeds(rasters.read_seeds(spark, a.seeds), get("flowdir", DIR), get("flowacc", ACC), get("mask", MASK)), a.output)
        case "threshold-mask":
            put(masks.threshold_mask(get("flowacc", ACC) if a.flowacc else get("strahler", GridType.Strahler), a.cutoff))
        case "mask-grid":
            put(masks.mask_grid(get("grid", a.grid_type), get("mask", MASK)))
        case "crop-grid":
            put(masks.crop_grid(get("grid", a.grid_type)))
        case "vectorize-network":
            fd = get("flowdir", DIR)
            lines.write_lines(network.vectorize_network(fd, get("flowacc", ACC) if a.flowacc else None), a.output, fd.meta.crs)
        case "vectorize-tree":
            fd = get("flowdir", DIR)
            accuracy = rasters.read_scores(spark, a.accuracy) if a.accuracy else None
            lines.write_lines(network.vectorize_tree(rasters.read_seeds(spark, a.seeds), fd, cutoff=a.cutoff, rank=a.rank, accuracy=accuracy), a.output, fd.meta.crs)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(args, SparkSession.builder.appName("rillflow").getOrCreate())


if __name__ == "__main__":
    main()
