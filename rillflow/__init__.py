"""Terrain-flow analytics on PySpark: grids as DataFrames of cells."""

from .model import Grid, GridMeta, GridType

__version__ = "0.1.0"
__all__ = ["Grid", "GridMeta", "GridType"]
