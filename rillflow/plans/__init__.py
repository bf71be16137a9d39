"""Iterative plans over functional graphs, and grids derived from tables."""
