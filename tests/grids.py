"""Random grids."""

import random


def dem(seed, h, w, holes=0.05, levels=None):
    r = random.Random(seed)
    z = [[(h - i) * 3.0 + (w - j) * 1.0 + r.uniform(0, 12) for j in range(w)] for i in range(h)]
    if levels:
        z = [[float(int(v) // levels) for v in row] for row in z]
    return [[None if r.random() < holes else v for v in row] for row in z]


def directions(seed, h, w, holes=0.05, sinks=0.05):
    """Any codes at all: cycles, border exits, sinks and holes."""
    r = random.Random(seed)
    return [[None if (x := r.random()) < holes else 0 if x < holes + sinks else 1 << r.randrange(8) for _ in range(w)] for _ in range(h)]
