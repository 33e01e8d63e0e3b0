"""Packed keys of cells far out."""

from __future__ import annotations

from latticeworks.grid import Grid
from latticeworks.operators import regions as R
from latticeworks.voxels import Voxels


def test_outmost_of_cells_beyond_a_million(spark):
    v = Voxels.cells(spark, [(3, 1, 1), (1_200_000, 1, 1), (7_200_000, 1, 1), (7_200_000, 1, 2)], Grid.of_cells((0, 0, 0), (7_200_001, 5, 5)))
    assert R.outmost(v).collect() == [(3, 1, 1)] and R.count_components(v) == 3
