"""Counts of flow directions over a stream of grid files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CODES


def windrose_stream(cells: DataFrame) -> DataFrame:
    """(dir, total) of a streaming frame of cells (row, col, dir); for the complete or update mode."""
    return cells.where(F.col("dir").isin(*CODES)).groupBy("dir").agg(F.count(F.lit(1)).alias("total"))
