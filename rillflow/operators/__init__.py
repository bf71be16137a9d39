"""Grid and drainage operators."""

from .evaluate import compare_flowdir, flowdir_windrose, windrose_emd
from .hydrology import delineate_watershed, flow_accumulation, huac, snap_pour_cell, strahler_order
from .masks import compare_watersheds, crop_grid, disaggregate_mask, mask_area, mask_grid, match_grids, threshold_mask
from .neighbours import d8, in_degree, receivers, upstream_neighbours
from .network import mask_seeds, river_tree, vectorize_network, vectorize_tree
from .upscale import COTAT, DMM, NSA

__all__ = [
    "COTAT", "DMM", "NSA", "compare_flowdir", "compare_watersheds", "crop_grid", "d8", "delineate_watershed", "disaggregate_mask", "flow_accumulation", "flowdir_windrose", "huac", "in_degree",
    "mask_area", "mask_grid", "mask_seeds", "match_grids", "receivers", "river_tree", "snap_pour_cell", "strahler_order", "threshold_mask", "upstream_neighbours", "vectorize_network", "vectorize_tree", "windrose_emd",
]
