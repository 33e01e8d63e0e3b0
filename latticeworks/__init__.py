"""Analytics over three-dimensional lattices of cells, on Spark DataFrames."""

from .grid import Grid
from .voxels import Voxels

__all__ = ["Grid", "Voxels"]
