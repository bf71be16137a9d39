import sqlite3

import models
import numpy as np
import pytest
from grids import dem

from rillflow import cli
from rillflow.model import GridType, from_rows
from rillflow.sources import rasters, read, tiff, write

X = None
CASES = [
    (GridType.DEM, [[1.5, X, -3.25], [0.0, 7.0, 9.125]], "double"),
    (GridType.DEM, [[1.5, X], [0.0, 7.0]], "float"),
    (GridType.DEM, [[1, X], [-5, 7]], "short"),
    (GridType.FlowDir, [[1, 128, 0], [X, 4, 2]], "int"),
    (GridType.FlowAcc, [[1, X], [2**40, 3]], "long"),
    (GridType.FlowAcc, [[1.25, X], [2.5, 3.0]], "double"),
    (GridType.Mask, [[True, False], [False, True]], "boolean"),
    (GridType.Tree, [[1, X], [X, 70000]], "long"),
    (GridType.Strahler, [[1, 2], [X, 3]], "int"),
]


@pytest.mark.parametrize("suffix", ["", ".tif", ".asc"])
@pytest.mark.parametrize("type,rows,dtype", CASES)
def test_round_trip(spark, tmp_path, type, rows, dtype, suffix):
    if suffix == ".asc" and type is GridType.Mask:
        pytest.skip("text of booleans")
    g = from_rows(spark, rows, type, dtype, a=0.5, e=-0.5, c=10.0, f=50.0, crs=None if suffix == ".asc" else "EPSG:32632")
    path = str(tmp_path / f"g{suffix}")
    write(g, path)
    back = read(spark, path, type)
    assert back.rows() == g.rows() and back.meta == g.meta
    with pytest.raises(FileExistsError):
        write(g, path)
    write(g, path, overwrite=True)


@pytest.mark.parametrize("dtype", ["uint8", "int16", "float32", "float64"])
@pytest.mark.parametrize("compress", ["deflate", "none"])
def test_codec(dtype, compress, tmp_path):
    from rillflow.model import GridMeta

    x = (np.random.default_rng(1).random((7, 11)) * 200).astype(dtype)
    with open(tmp_path / "x.tif", "wb") as out:
        tiff.encode(list(x), GridMeta(7, 11, crs="EPSG:4326"), dtype, None, out, compress)
    image = tiff.Tiff((tmp_path / "x.tif").read_bytes())
    got = np.concatenate([v for _, _, v in image.parts()])
    assert (got == x).all() and image.meta == GridMeta(7, 11, crs="EPSG:4326")
    with pytest.raises(ValueError):
        tiff.Tiff(b"PNG not tiff")


def test_all_verbs(spark, tmp_path, capsys):
    p = lambda n: str(tmp_path / n)
    run = lambda *a: cli.run(cli.parser().parse_args([str(x) for x in a]), spark)
    z = dem(21, 16, 16, holes=0)
    write(from_rows(spark, z, GridType.DEM, crs="EPSG:32632", f=16.0), p("dem.tif"))
    run("d8", "--dem", p("dem.tif"), "-o", p("fd.tif"))
    fd = models.d8(z)
    assert read(spark, p("fd.tif")).rows() == fd
    run("flowacc", "--flowdir", p("fd.tif"), "-o", p("fa.tif"), "--cells")
    acc = models.accumulate(fd)[0]
    assert read(spark, p("fa.tif"), GridType.FlowAcc).rows() == acc
    top = max(models.cells(acc), key=lambda q: models.at(acc, q))
    xy = ["--x", top[1] + 0.5, "--y", 16 - top[0] - 0.5, "--radius", 0.1]
    run("watershed", "--flowdir", p("fd.tif"), *xy, "--flowacc", p("fa.tif"), "-o", p("ws.tif"))
    run("watershed", "--flowdir", p("fd.tif"), *xy, "-o", p("ws2.tif"))
    assert read(spark, p("ws.tif"), GridType.Mask).rows() == models.watershed(fd, top) == read(spark, p("ws2.tif"), GridType.Mask).rows()
    run("compare-watersheds", "--mask1", p("ws.tif"), "--mask2", p("ws2.tif"), "-o", p("both"))
    assert capsys.readouterr().out.strip().splitlines()[-1] == "1.0000"
    run("nsa", "--flowacc", p("fa.tif"), "-k", 4, "-o", p("nsa.tif"))
    run("dmm", "--flowacc", p("fa.tif"), "-k", 4, "-o", p("dmm.tif"))
    run("cotat", "--flowdir", p("fd.tif"), "--flowacc", p("fa.tif"), "-k", 4, "-o", p("cotat.tif"), "--area-threshold", 1)
    assert read(spark, p("nsa.tif")).rows() == models.nsa(acc, 4)
    run("strahler", "--flowdir", p("fd.tif"), "-o", p("st.tif"))
    run("threshold-mask", "--strahler", p("st.tif"), "--cutoff", 2, "-o", p("tm.tif"))
    run("threshold-mask", "--flowacc", p("fa.tif"), "--cutoff", 3, "-o", p("tm.tif"))
    run("mask-grid", "--grid", p("fa.tif"), "--grid-type", "flowacc", "--mask", p("tm.tif"), "-o", p("mg.tif"))
    run("crop-grid", "--grid", p("mg.tif"), "--grid-type", "FlowAcc", "-o", p("cg.tif"))
    run("river-tree", "--flowdir", p("fd.tif"), "--flowacc", p("fa.tif"), "--o-tree", p("tree.tif"), "--o-seeds", p("seeds.npz"))
    assert rasters.read_seeds(spark, p("seeds.npz")).count() == len(models.river_tree(fd, acc)[1])
    run("mask-seeds", "--seeds", p("seeds.npz"), "--flowdir", p("fd.tif"), "--flowacc", p("fa.tif"), "--mask", p("tm.tif"), "-o", p("ms.npz"))
    run("compare-flowdir", "--flowdir-fine", p("fd.tif"), "--flowdir-coarse", p("nsa.tif"), "--seeds", p("seeds.npz"), "-o", p("scores.npy"), "--cascade")
    assert len(np.load(p("scores.npy"))) == rasters.read_seeds(spark, p("seeds.npz")).count()
    run("vectorize-network", "--flowdir", p("fd.tif"), "--flowacc", p("fa.tif"), "-o", p("net.gpkg"))
    run("vectorize-tree", "--seeds", p("seeds.npz"), "--flowdir", p("fd.tif"), "--rank", 2, "--accuracy", p("scores.npy"), "-o", p("tree.gpkg"))
    assert sqlite3.connect(p("net.gpkg")).execute("SELECT count(*) FROM lines").fetchone()[0] == len(models.network(fd))
    run("flowacc", "--flowdir", p("nsa.tif"), "-o", p("ca.tif"), "--cells")
    run("huac", "--flowacc-fine", p("fa.tif"), "--flowdir-coarse", p("nsa.tif"), "--flowacc-coarse", p("ca.tif"), "--x", 8, "--y", 8, "--radius", 20, "--o-raster", p("err.tif"), "--o-csv", p("h.csv"))
    assert (tmp_path / "h.csv").read_text().startswith("cell_row,cell_col,")
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["crop-grid", "--grid", "x", "--grid-type", "nope", "-o", "y"])


def test_streamed_windrose(spark, tmp_path):
    from rillflow.streaming import windrose_stream

    spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 4), (1, 1, 0)], "row int, col int, dir int").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("row int, col int, dir int").parquet(str(tmp_path / "in"))
    q = windrose_stream(source).writeStream.outputMode("complete").format("memory").queryName("rose").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.dir, r.total) for r in spark.table("rose").collect()} == {(1, 2), (4, 1)}


def packed_lzw(data):
    """TIFF LZW of some bytes, for the test only."""
    out, bits, held, table, width = bytearray(), 0, 0, {bytes((i,)): i for i in range(256)}, 9

    def put(code):
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
            bits &= (1 << held) - 1

    put(256)
    word = b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        put(table[word])
        table[word + c] = len(table) + 2
        n = len(table) + 2
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n >= 4094:
            put(256)
            table, width = {bytes((i,)): i for i in range(256)}, 9
        word = c
    if word:
        put(table[word])
    put(257)
    out.append(bits << (8 - held) & 255)
    return bytes(out)


def big_tiff(x, compression, pack, keys):
    """A BigTIFF file of one strip."""
    import struct

    raw = pack(x.astype("<i2").tobytes())
    fields = [(256, 4, (x.shape[1],)), (257, 4, (x.shape[0],)), (258, 3, (16,)), (259, 3, (compression,)), (273, 16, (16,)), (277, 3, (1,)), (278, 4, (x.shape[0],)), (279, 16, (len(raw),)), (339, 3, (2,)), (34735, 3, keys)]
    raw += b"\0" * (len(raw) % 2)
    at, extra, table = 16 + len(raw), b"", struct.pack("<Q", len(fields))
    for tag, kind, values in fields:
        body = struct.pack(f"<{len(values)}{ {3: 'H', 4: 'I', 16: 'Q'}[kind] }", *values)
        table += struct.pack("<HHQ", tag, kind, len(values))
        if len(body) > 8:
            table += struct.pack("<Q", at + 8 + 20 * len(fields) + 8 + len(extra))
            extra += body
        else:
            table += body.ljust(8, b"\0")
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) + raw + table + b"\0" * 8 + extra


def test_big_tiff_with_other_compressions(spark, tmp_path):
    import zstandard

    x = (np.arange(90 * 70).reshape(90, 70) * 7919 % 301).astype("int16")
    x[:40] = 5
    keys = (1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4283)
    for compression, pack in ((1, bytes), (5, packed_lzw), (50000, lambda b: zstandard.ZstdCompressor().compress(b))):
        path = str(tmp_path / f"x{compression}.tif")
        with open(path, "wb") as out:
            out.write(big_tiff(x, compression, pack, keys))
        grid = read(spark, path, GridType.DEM)
        assert grid.meta.crs == "EPSG:4283" and grid.meta.geographic and grid.shape == x.shape
        got = np.zeros_like(x)
        for r in grid.df.collect():
            got[r.row, r.col] = r.z
        assert (got == x).all()
