"""Components, floods and distances.

Components and floods are made tile by tile and joined where tiles meet (see
:mod:`.tiles`); floods of what is unset go over the tiles of the cells' box.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..grid import AXES, Grid, Triple, key, steps
from ..settings import join_small, settle, written
from ..voxels import BIT, U32, Voxels
from . import tiles
from .boolean import KEY, invert, union


def run_cells(of: DataFrame, *more: str | Column) -> DataFrame:
    """The cells of runs."""
    return of.select("gi", "gj", F.explode(F.sequence("k0", "k1")).alias("gk"), *more)


def _labelled(a: Voxels, connectivity: int = 6) -> tiles.Labelled:
    a.grid.packable()
    return tiles.labelled(a.df.select(*KEY), connectivity, a.parts)


def components(a: Voxels, connectivity: int = 6) -> DataFrame:
    """(gi, gj, gk, label) of every set cell; labels ascend in the order of components' first cells."""
    return run_cells(_labelled(a, connectivity).runs(), "label")


def _sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("label").agg(
        F.sum("n").alias("count"),
        F.min("gi").alias("lo_i"), F.min("gj").alias("lo_j"), F.min("gk").alias("lo_k"),
        F.max("hi").alias("hi_i"), F.max("hj").alias("hi_j"), F.max("hk").alias("hi_k"),
    )


def component_sizes(a: Voxels, connectivity: int = 6) -> DataFrame:
    """(label, count, lo and hi of each axis); labels ascend in the order of first cells."""
    return _sizes(_labelled(a, connectivity).parts())


def count_components(a: Voxels) -> int:
    return _labelled(a).parts().select("label").distinct().count()


def keep_components(a: Voxels, min_size: int) -> Voxels:
    """Cells of components of at least ``min_size`` cells."""
    found = _labelled(a)
    parts = found.parts()
    big = parts.groupBy("label").agg(F.sum("n").alias("_n")).where(F.col("_n") >= min_size)
    kept = run_cells(found.runs_of(parts.join(big, "label", "left_semi")))
    return a.with_df(a.df.join(kept, KEY, "left_semi") if a.kind != BIT else kept)


def outmost(a: Voxels) -> Voxels:
    """The component of the cell that is first in index order."""
    found = _labelled(a)
    parts = found.parts()
    first = parts.agg(F.min("label")).first()[0]
    if first is None:
        return a.bits()
    return Voxels(run_cells(found.runs_of(parts.where(F.col("label") == first))), a.grid, parts=a.parts)


class Component(Voxels):
    """A component of a bit grid: its size and bounds are known, its cells are looked up where they are asked for."""

    def __init__(self, grid: Grid, size: Row, cells: Callable[[], DataFrame]):
        for name, value in (("grid", grid), ("kind", BIT), ("parts", None), ("_size", size), ("_cells", cells)):
            object.__setattr__(self, name, value)

    @cached_property
    def df(self) -> DataFrame:  # type: ignore[override]
        return self._cells()

    def with_df(self, df: DataFrame, **more) -> Voxels:
        return replace(Voxels(df, self.grid, self.kind), **more)

    def count(self) -> int:
        return self._size["count"]

    def is_empty(self) -> bool:
        return False

    def bounds(self) -> tuple[Triple, Triple]:
        return tuple(tuple(self._size[f"{n}_{x}"] for x in "ijk") for n in ("lo", "hi"))  # type: ignore[return-value]


def component_iterator(a: Voxels) -> Iterator[Voxels]:
    """Each component as a grid, in order; of an integer grid the cells of each value."""
    if a.kind == U32:
        for (v,) in a.df.select("val").distinct().orderBy("val").toLocalIterator():
            yield Voxels(a.df.where(F.col("val") == v).select(*KEY), a.grid)
        return
    found = _labelled(a)
    runs = cache(lambda: written(found.runs()))
    for s in _sizes(found.parts()).orderBy("label").toLocalIterator():
        yield Component(a.grid, s, lambda label=s["label"]: run_cells(runs().where(F.col("label") == label)))


def component_foreach(a: Voxels, fn: Callable[[Voxels], object]) -> int:
    """Calls ``fn`` with each component; their number."""
    n = 0
    for c in component_iterator(a):
        fn(c)
        n += 1
    return n


def _box(a: Voxels) -> tuple[Triple, Triple] | None:
    """The set cells' box with one cell around, within the extent; None if nothing is set."""
    b = a.bounds()
    if b is None:
        return None
    lo = tuple(max(x - 1, y) for x, y in zip(b[0], a.grid.lo, strict=True))
    hi = tuple(min(x + 1, y) for x, y in zip(b[1], a.grid.hi, strict=True))
    return lo, hi  # type: ignore[return-value]


def _outside() -> Column:
    """Label of the outside of a box: that of its first corner, which is unset."""
    return key(F.col("i0"), F.col("j0"), F.col("k0"))


def _open_runs(a: Voxels) -> tuple[tiles.Labelled, DataFrame, Triple, Triple] | None:
    """Unset cells of the padded box by components, parts of these with the box, and the box."""
    a.grid.packable()
    b = a.bounds()
    box = _box(a)
    if b is None or box is None:
        return None
    if any(x <= y for x, y in zip(b[0], a.grid.lo, strict=True)):
        raise ValueError("Not enough padding for outside fill")
    lo, hi = box
    bounds = [x for pair in zip(lo, hi, strict=True) for x in pair]
    boxes = a.spark.createDataFrame([(0, *bounds)], "part long, i0 long, i1 long, j0 long, j1 long, k0 long, k1 long")
    found = tiles.unset(a.df.select(F.lit(0).cast("long").alias("part"), *KEY), boxes, a.parts)
    return found, found.parts().crossJoin(F.broadcast(boxes.select("i0", "j0", "k0"))), lo, hi


def exterior(a: Voxels) -> Voxels:
    """Unset cells that the outside reaches by faces, over the whole extent; of an empty grid the grid itself."""
    opened = _open_runs(a)
    if opened is None:
        return a
    found, parts, lo, hi = opened
    near = run_cells(found.runs_of(parts.where(F.col("label") == _outside())))
    box = F.lit(True)
    for axis, x, y in zip(AXES, lo, hi, strict=True):
        box = box & F.col(axis).between(x, y)
    return Voxels(near.unionByName(a.grid.cells(a.spark).where(~box)), a.grid)


def interior(a: Voxels) -> Voxels:
    """Unset cells that the outside doesn't reach."""
    opened = _open_runs(a)
    if opened is None:
        return Voxels.empty(a.spark, a.grid)
    found, parts, _, _ = opened
    return Voxels(run_cells(found.runs_of(parts.where(F.col("label") != _outside()))), a.grid)


def shell_and_interior(a: Voxels) -> Voxels:
    """Everything but the exterior."""
    return union(a.bits(), interior(a))


volume2 = interior


def enclosed(cells: DataFrame, parts: int | None = None) -> DataFrame:
    """(part, cell): cells that a part's own (part, cell) cut off from the outside of its box."""
    bounds = [f(F.col(g)).alias(f"{g}{n}") for g in AXES for f, n in ((F.min, 0), (F.max, 1))]
    box = cells.groupBy("part").agg(*bounds)
    # what encloses a cell goes around it along every axis
    box = box.where(" AND ".join(f"{g}1 - {g}0 >= 2" for g in AXES))
    box = written(box.select("part", *((F.col(f"{g}{n}") + 2 * n - 1).alias(f"{g[1]}{n}") for g in AXES for n in (0, 1))))
    found = tiles.unset(join_small(cells, box.select("part"), "part", "left_semi"), box, parts)
    closed = join_small(found.parts(), box.select("part", "i0", "j0", "k0"), "part", "inner").where(F.col("label") != _outside())
    return run_cells(found.runs_of(closed), "part")


def volume(a: Voxels) -> Voxels:
    """Cells that some 6-connected component, taken alone, cuts off from the outside.

    Cells of another component that lies within are enclosed too, and so belong.
    """
    if a.is_empty():
        return a.bits()
    own = run_cells(_labelled(a).runs(), F.col("label").alias("part"))
    return Voxels(enclosed(own, a.parts).select(*KEY).distinct().where(a.grid.inside()), a.grid)


def fill_volume(a: Voxels) -> Voxels:
    return union(volume(a), a.bits())


def _passable(a: Voxels, seed: Voxels) -> Voxels:
    """The cells to search: set ones if the seeds are set, unset ones if they are not; mixed seeds are an error."""
    if a.grid.offset != seed.grid.offset or abs(a.grid.size - seed.grid.size) > 1e-7:
        raise ValueError("grid offsets differ")
    within = seed.bits().df.join(a.df.select(*KEY).withColumn("_v", F.lit(1)), KEY, "left")
    n, n_set = within.agg(F.count("*"), F.count("_v")).first()
    if n_set not in (0, n):
        raise ValueError("Valuation for seed not constant")
    return a.bits() if n_set or not n else invert(a)


def traverse(a: Voxels, seed: Voxels, depth: float | None = None, connectedness: int = 6, kind: str = "bit") -> Voxels:
    """Cells reached from the seeds; for kind ``uint`` (26 only) trunc(10 * distance + 1) as values."""
    if connectedness not in (6, 26):
        raise ValueError("Connectedness should be 6 or 26")
    if kind not in ("bit", "uint"):
        raise ValueError(f"Unsupported type {kind}")
    if kind == "uint" and connectedness != 26:
        raise ValueError("uint needs connectedness 26")
    space = _passable(a, seed)
    start = seed.bits().df.where(a.grid.inside())
    if depth is None and kind == "bit":
        r = written(_labelled(space, connectedness).runs())
        at = join_small(r, written(start.withColumnRenamed("gk", "_k")), ["gi", "gj"], "inner").where("_k BETWEEN k0 AND k1").select("label").distinct()
        return Voxels(run_cells(join_small(r, written(at), "label", "left_semi")), a.grid)
    found = distances(space, start, connectedness, depth)
    if kind == "uint":
        return Voxels(found.select(*KEY, F.floor(10 * F.col("dist") + 1).alias("val")), a.grid, U32)
    return Voxels(found.select(*KEY), a.grid)


SLACK = 1e-9


def distances(space: Voxels, start: DataFrame, connectedness: int, depth: float | None = None) -> DataFrame:
    """(cell, dist): length of the shortest chain of neighbour steps from a start cell through set cells.

    Rounds relax only cells that improved. Distances are rounded to nine places, so that sums in
    different orders of steps agree."""
    near = F.array(*(F.struct(*(F.lit(x).cast("long").alias(n) for x, n in zip(s, "ijk", strict=True)), F.lit(sum(x * x for x in s) ** 0.5).alias("w")) for s in steps(connectedness)))
    cells = settle(space.df.select(*KEY))
    best = settle(start.select(*KEY).distinct().withColumn("dist", F.lit(0.0)))
    fresh = best
    while True:
        moved = fresh.withColumn("_s", F.explode(near))
        moved = moved.select(*((F.col(x) + F.col(f"_s.{n}")).alias(x) for x, n in zip(AXES, "ijk", strict=True)), F.round(F.col("dist") + F.col("_s.w"), 9).alias("dist"))
        if depth is not None:
            moved = moved.where(F.col("dist") <= depth + SLACK)
        moved = moved.groupBy(*KEY).agg(F.min("dist").alias("dist")).join(cells, KEY, "left_semi")
        old = best.withColumnRenamed("dist", "_old")
        fresh = settle(moved.join(old, KEY, "left").where(F.col("_old").isNull() | (F.col("dist") < F.col("_old"))).select(*KEY, "dist"))
        if fresh.isEmpty():
            return best
        best = settle(best.unionByName(fresh).groupBy(*KEY).agg(F.min("dist").alias("dist")))
