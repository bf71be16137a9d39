"""Readers and writers of grids, seeds, scores and lines."""

from .rasters import read, write

__all__ = ["read", "write"]
