"""Grids in and out: Parquet folders (the primary format), ESRI ASCII grids, GeoTIFF."""

from __future__ import annotations

import contextlib
import os
import pickle
import tempfile
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import VALUE, Grid, GridMeta, GridType
from ..operators.network import ranked
from . import tiff

#: Value type and no-data of each grid type in a GeoTIFF; None: by the Spark type.
FILES = {GridType.FlowDir: ("uint8", 255), GridType.Mask: ("uint8", 255), GridType.Tree: ("uint32", 0), GridType.Strahler: ("uint8", 0)}
BY_TYPE = {T.DoubleType(): ("float64", float("nan")), T.FloatType(): ("float32", float("nan")), T.LongType(): ("int64", 2**63 - 1), T.IntegerType(): ("int32", 2**31 - 1), T.ShortType(): ("int16", 2**15 - 1)}


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read(spark: SparkSession, path: str, grid_type: GridType = GridType.FlowDir) -> Grid:
    """A grid of any of the formats, by the path's suffix; values are made canonical for the type."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix in (".tif", ".tiff"):
        return read_tiff(spark, path, grid_type)
    if suffix == ".asc":
        return read_ascii(spark, path, grid_type)
    meta = spark.read.parquet(f"{path}/meta").first().asDict()
    return Grid.create(spark.read.parquet(f"{path}/cells"), grid_type, GridMeta(**meta), VALUE[grid_type])


def write(grid: Grid, path: str, *, overwrite: bool = False, compress: str = "deflate") -> None:
    """Write a grid; FileExistsError unless told to overwrite."""
    spark = grid.df.sparkSession
    if not overwrite and exists(spark, path):
        raise FileExistsError(path)
    suffix = os.path.splitext(path)[1].lower()
    if suffix in (".tif", ".tiff"):
        return write_tiff(grid, path, compress)
    if suffix == ".asc":
        return write_ascii(grid, path)
    schema = "nrows int, ncols int, a double, b double, c double, d double, e double, f double, crs string, degrees boolean"
    spark.createDataFrame([tuple(asdict(grid.meta).values())], schema).write.mode("overwrite").parquet(f"{path}/meta")
    grid.df.write.mode("overwrite").parquet(f"{path}/cells")


def heads(frames):
    """The tags of a file without its pixels, read where the file is."""
    for frame in frames:
        for content in frame["content"]:
            own = tiff.Tiff(bytes(content))
            own.data = b""
            yield pd.DataFrame({"head": [pickle.dumps(own)]})


def read_tiff(spark: SparkSession, path: str, grid_type: GridType) -> Grid:
    """Files are read through Spark, and decoded by one task each, strip by strip."""
    files = spark.read.format("binaryFile").load(path)
    head = files.select("content").mapInPandas(heads, "head binary").first()
    head = pickle.loads(bytes(head.head))
    name, whole = VALUE[grid_type], head.dtype.kind in "ui"
    wide = {("f", 4): "float", ("f", 8): "double", ("i", 2): "short", ("i", 4): "int", ("u", 1): "int", ("u", 2): "int"}.get((head.dtype.kind, head.dtype.itemsize), "long")

    def decode(frames):
        for frame in frames:
            for content in frame["content"]:
                for r, c, x in tiff.Tiff(bytes(content)).parts():
                    i, j = np.mgrid[r : r + x.shape[0], c : c + x.shape[1]]
                    yield pd.DataFrame({"row": i.ravel().astype("int32"), "col": j.ravel().astype("int32"), name: x.ravel().astype("int64" if whole else x.dtype.newbyteorder("="))})

    df = files.select("content").mapInPandas(decode, f"row int, col int, {name} {'long' if whole else wide}")
    if whole and wide != "long":
        df = df.withColumn(name, F.col(name).cast(wide))
    return Grid.create(df, grid_type, head.meta, nodata=head.nodata)


def dense_rows(grid: Grid, missing) -> object:
    """The rows of the grid as arrays, top down, streamed to the driver one partition at a time."""
    every = grid.df.groupBy("row").agg(F.collect_list(F.struct("col", grid.value)).alias("cells")).orderBy("row")
    nothing, at = np.full(grid.meta.ncols, missing), 0
    for r in every.toLocalIterator():
        for _ in range(at, r.row):
            yield nothing.copy()
        row = nothing.copy()
        for c, v in r.cells:
            if v is not None:
                row[c] = v
        yield row
        at = r.row + 1
    for _ in range(at, grid.meta.nrows):
        yield nothing.copy()


@contextlib.contextmanager
def output(spark: SparkSession, path: str, mode: str):
    """A file open for writing; one in another file system is written on the driver and then copied there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getUri().getScheme() == "file":
        with open(place.toUri().getPath(), mode) as out:
            yield out
        return
    with tempfile.TemporaryDirectory() as folder:
        local = os.path.join(folder, "out")
        with open(local, mode) as out:
            yield out
        files.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path("file://" + local), place)


def write_tiff(grid: Grid, path: str, compress: str = "deflate") -> None:
    dtype, nodata = FILES.get(grid.type) or BY_TYPE[grid.df.schema[grid.value].dataType]
    with output(grid.df.sparkSession, path, "wb") as out:
        tiff.encode((x.astype(dtype) for x in dense_rows(grid, np.array(nodata, dtype)[()])), grid.meta, dtype, nodata, out, compress)


def write_ascii(grid: Grid, path: str) -> None:
    """ESRI ASCII grid; square pixels only."""
    m = grid.meta
    if abs(m.a + m.e) > 1e-12:
        raise ValueError("an ASCII grid needs square pixels")
    with output(grid.df.sparkSession, path, "w") as out:
        out.write(f"ncols {m.ncols}\nnrows {m.nrows}\nxllcorner {m.c!r}\nyllcorner {m.f + m.nrows * m.e!r}\ncellsize {m.a!r}\nNODATA_value -9999\n")
        whole = not isinstance(grid.df.schema[grid.value].dataType, (T.DoubleType, T.FloatType))
        for row in dense_rows(grid, -9999 if whole else -9999.0):
            out.write(" ".join(str(int(v)) if whole else repr(float(v)) for v in row) + "\n")


def read_ascii(spark: SparkSession, path: str, grid_type: GridType) -> Grid:
    """Lines are numbered in file order without bringing them into one task."""
    lines = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    head = {k.lower(): v for k, v in (r.value.split() for r in lines.orderBy("id").limit(6).collect()) if k[0].isalpha()}
    if "ncols" not in head or "nrows" not in head:
        raise ValueError("not an ASCII grid")
    size, ncols, nrows = float(head["cellsize"]), int(head["ncols"]), int(head["nrows"])
    shift = size / 2 if "xllcenter" in head else 0.0
    left, low = (float(head[f"{k}llcorner"] if f"{k}llcorner" in head else head[f"{k}llcenter"]) - shift for k in "xy")
    meta = GridMeta(nrows, ncols, a=size, c=left, e=-size, f=low + nrows * size)
    numbered = ranked(lines.where("value RLIKE '\\\\S'"), [F.col("id").asc()], "place")
    values = numbered.where(F.col("place") > len(head)).select((F.col("place") - len(head) - 1).alias("row"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("col", "text"))
    kind = "double" if grid_type in (GridType.DEM, GridType.FlowAcc) else "int"
    df = values.select("row", "col", F.col("text").cast("double").cast(kind).alias(VALUE[grid_type]))
    return Grid.create(df, grid_type, meta, nodata=float(head.get("nodata_value", "nan")))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds of a Parquet folder, or of an .npz file with an array ``seeds``."""
    if not path.lower().endswith(".npz"):
        return spark.read.parquet(path)
    loaded = np.load(path, allow_pickle=False)
    if "seeds" not in loaded:
        raise ValueError("the file has no array named seeds")
    frame = pd.DataFrame({n: loaded["seeds"][n].astype("float64" if loaded["seeds"][n].dtype.kind == "f" else "int64") for n in loaded["seeds"].dtype.names})
    frame.insert(0, "seed_id", np.arange(1, len(frame) + 1))
    return spark.createDataFrame(frame)


def write_seeds(seeds: DataFrame, path: str) -> None:
    if not path.lower().endswith(".npz"):
        return seeds.write.mode("overwrite").parquet(path)
    frame = seeds.orderBy("seed_id").toPandas()
    names = ["mouth_row", "mouth_col", "headwater_row", "headwater_col", "ncells"]
    kinds = [(n, "u4") for n in names] + [("acc", frame["acc"].dtype.str), ("length_m", "f8")]
    np.savez(path, seeds=np.array(list(frame[[n for n, _ in kinds]].itertuples(index=False, name=None)), dtype=kinds))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(seed_id, score) of a Parquet folder or of an .npy vector in seed order."""
    if not path.lower().endswith(".npy"):
        return spark.read.parquet(path)
    scores = np.load(path, allow_pickle=False)
    return spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(scores)], "seed_id long, score float")


def write_scores(scores: DataFrame, path: str) -> None:
    if not path.lower().endswith(".npy"):
        return scores.write.mode("overwrite").parquet(path)
    np.save(path, np.array([r.score for r in scores.orderBy("seed_id").toLocalIterator()], np.float32))
