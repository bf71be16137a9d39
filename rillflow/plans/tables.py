"""Grids derived from the relational tables: a dense key becomes row and column."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import Grid, GridMeta, GridType

WIDTH, TILT = 100, 20_000.0
#: Planar and spherical references of the derived grids.
PLANE = {"a": 1.0, "e": -1.0, "crs": "EPSG:32632"}
SPHERE = {"a": 0.01, "e": -0.01, "c": 8.0, "f": 48.0}


def elevation(spark: SparkSession, sf_dir: str, *, holes: bool = False, tilt: float = TILT, reference: dict | None = None) -> Grid:
    """Order prices on a slope: row = key div WIDTH, col = key mod WIDTH; with holes where the status is P."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    nrows = orders.agg(F.max("o_orderkey")).first()[0] // WIDTH + 1
    z = F.expr(f"(cast({nrows} - o_orderkey div {WIDTH} AS double) * {tilt}D) + o_totalprice")
    z = F.when(F.col("o_orderstatus") != "P", z) if holes else z
    df = orders.select(F.expr(f"int(o_orderkey div {WIDTH})").alias("row"), F.expr(f"int(o_orderkey % {WIDTH})").alias("col"), z.alias("z"))
    return Grid.create(df, GridType.DEM, GridMeta(nrows, WIDTH, **(reference or PLANE)))


def parts(spark: SparkSession, sf_dir: str) -> Grid:
    """Part sizes as a second grid of counts."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    nrows = part.agg(F.max("p_partkey")).first()[0] // WIDTH + 1
    df = part.select(F.expr(f"int(p_partkey div {WIDTH})").alias("row"), F.expr(f"int(p_partkey % {WIDTH})").alias("col"), F.col("p_size").cast("long").alias("acc"))
    return Grid.create(df, GridType.FlowAcc, GridMeta(nrows, WIDTH, **PLANE))
