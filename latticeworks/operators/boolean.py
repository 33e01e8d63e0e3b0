"""Set operations of aligned grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import AXES
from ..voxels import BIT, NORMAL, U32, Voxels

KEY = list(AXES)


def _ready(a: Voxels, b: Voxels) -> None:
    a.grid.check(b.grid)
    if NORMAL in (a.kind, b.kind):
        raise ValueError("set operations need bit or integer voxels")


def spread(rows: DataFrame, times: int, *of: Voxels) -> DataFrame:
    """Rows (cell, ...) made of grids, so many for a cell, dealt over as many tasks as that takes, so that what a task holds is bounded;
    as they are where the grids don't say."""
    n = times * sum(v.parts or 0 for v in of)
    return rows.repartition(n, *KEY) if n else rows


def _more(a: Voxels, b: Voxels) -> int | None:
    return (a.parts or 0) + (b.parts or 0) or None


def union(a: Voxels, b: Voxels, if_non_empty: bool = False) -> Voxels:
    """Cells of either; of integer grids b's values win. With if_non_empty and an empty b, a itself."""
    if if_non_empty and b.is_empty():
        return a
    _ready(a, b)
    grid = a.grid.hull(b.grid)
    if a.kind != b.kind:
        raise ValueError("union of an integer and a bit grid")
    if a.kind == BIT:
        return Voxels(spread(a.df.unionByName(b.df), 1, a, b).distinct(), grid, parts=_more(a, b))
    own = a.df.withColumn("from_b", F.lit(0)).unionByName(b.df.withColumn("from_b", F.lit(1)))
    return Voxels(spread(own, 1, a, b).groupBy(*KEY).agg(F.max_by("val", "from_b").alias("val")), grid, U32, _more(a, b))


def subtract(a: Voxels, b: Voxels, if_non_empty: bool = False) -> Voxels:
    """Cells of a that b doesn't have, with a's values; the extent is that of both."""
    if if_non_empty and b.is_empty():
        return a
    _ready(a, b)
    return a.with_df(a.df.join(b.df.select(*KEY), KEY, "left_anti"), grid=a.grid.hull(b.grid))


def intersect(a: Voxels, b: Voxels, if_non_empty: bool = False) -> Voxels:
    """Cells of both; two integer grids give the bitwise and of the values where that isn't 0."""
    if if_non_empty and b.is_empty():
        return a
    _ready(a, b)
    grid = a.grid.hull(b.grid)
    if a.kind == U32 and b.kind == U32:
        both = a.df.join(b.df.withColumnRenamed("val", "other"), KEY)
        both = both.select(*KEY, F.col("val").bitwiseAND(F.col("other")).alias("val")).where("val <> 0")
        return Voxels(both, grid, U32)
    if a.kind == BIT and b.kind == U32:
        raise ValueError("intersection of a bit grid with an integer grid; swap them")
    return a.with_df(a.df.join(b.df.select(*KEY), KEY, "left_semi"), grid=grid)


def union_in_place(a: Voxels, b: Voxels) -> Voxels:
    """Union that needs equal extents, as a grid that is written into does."""
    _same_extent(a, b)
    return union(a, b)


def subtract_in_place(a: Voxels, b: Voxels) -> Voxels:
    _same_extent(a, b)
    return subtract(a, b)


def intersect_in_place(a: Voxels, b: Voxels) -> Voxels:
    _same_extent(a, b)
    return intersect(a, b)


def _same_extent(a: Voxels, b: Voxels) -> None:
    if a.grid.dims != b.grid.dims or a.grid.offset != b.grid.offset:
        raise ValueError("extents differ")


def invert(a: Voxels) -> Voxels:
    """All unset cells of the grid's whole extent."""
    return Voxels(a.grid.cells(a.spark).join(a.df.select(*KEY), KEY, "left_anti"), a.grid)


def zeros(a: Voxels) -> Voxels:
    return Voxels.empty(a.spark, a.grid, a.kind)


def constant_like(a: Voxels, value: int, kind: str = BIT) -> Voxels:
    """A grid of a's extent: every cell set for value 1, none for any other."""
    if kind not in ("bit", "uint", U32):
        raise ValueError(f"Unsupported type {kind}")
    of = BIT if kind == "bit" else U32
    if value != 1:
        return Voxels.empty(a.spark, a.grid, of)
    cells = a.grid.cells(a.spark)
    return Voxels(cells if of == BIT else cells.withColumn("val", F.lit(1).cast("long")), a.grid, of)


def copy(a: Voxels, kind: str | None = None) -> Voxels:
    """The same grid; ``kind`` bit drops values."""
    if kind is None or kind == a.kind:
        return a
    if kind != "bit":
        raise NotImplementedError(f"copy as {kind}")
    return a.bits()


def put(x: float, y: float, z: float, into: Voxels, as_cells: bool = False) -> Voxels:
    """A grid with the cell at a point (or, of integers, at an index relative to the extent) set as well."""
    cell = tuple(a + int(v) for a, v in zip(into.grid.lo, (x, y, z), strict=True)) if as_cells else into.grid.index(x, y, z)
    if not into.grid.holds(cell):
        raise ValueError("outside the grid")
    return into.with_cell(*cell)
