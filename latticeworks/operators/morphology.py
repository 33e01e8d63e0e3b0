"""Neighbourhoods, shifts, sweeps and resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import AXES, Grid, Triple, steps
from ..voxels import BIT, U32, Voxels
from . import tiles
from .boolean import KEY, spread, union
from .words import dilated


def neighbours(cells: DataFrame, around: list[Triple], more: list[Column] | None = None) -> DataFrame:
    """Each cell's neighbours by the given steps, one row each."""
    table = F.array(*(F.struct(*(F.lit(x).cast("long").alias(n) for x, n in zip(s, "ijk", strict=True))) for s in around))
    out = cells.withColumn("_s", F.explode(table))
    moved = [(F.col(a) + F.col(f"_s.{n}")).alias(a) for a, n in zip(AXES, "ijk", strict=True)]
    return out.select(*moved, *(more or []))


_CELL = "gi long, gj long, gk long"


def _own(tile: tiles.Tile, at: np.ndarray) -> dict[str, np.ndarray]:
    """Those places that lie in the tile itself, as cells."""
    c = tile.cells(at)
    here = tile.holds(c)
    return {n: x[here] for n, x in zip(KEY, c, strict=True)}


def offset(a: Voxels) -> Voxels:
    """Unset cells next to a set one (26 neighbours), within the extent."""

    def around(tile: tiles.Tile, at: np.ndarray) -> dict[str, np.ndarray]:
        near = tile.dense(np.empty(0, np.int64))
        for s in steps(26):
            near[at + tile.step(s)] = True
        near[at] = False
        return _own(tile, np.flatnonzero(near))

    return Voxels(tiles.settled(a.df.select(*KEY), 1, _CELL, around, a.parts).where(a.grid.inside()), a.grid, parts=a.parts)


def offset_xy(a: Voxels, d: int) -> Voxels:
    """The cells and all within d columns of them in their layer, within the extent."""
    if d <= 0:
        return a.bits()
    if d > tiles.AROUND:
        return Voxels(dilated(a.df.select(*KEY), d, z=False).where(a.grid.inside()), a.grid)

    def around(tile: tiles.Tile, at: np.ndarray) -> dict[str, np.ndarray]:
        for s in ((1, 0, 0), (0, 1, 0)):
            near = tile.dense(np.empty(0, np.int64))
            for n in range(-d, d + 1):
                near[at + n * tile.step(s)] = True
            at = np.flatnonzero(near)
        return _own(tile, at)

    return Voxels(tiles.settled(a.df.select(*KEY), d, _CELL, around, a.parts).where(a.grid.inside()), a.grid, parts=a.parts)


def fill_gaps(a: Voxels) -> Voxels:
    """The cells and every unset cell between two set ones of an axis."""

    def filled(tile: tiles.Tile, at: np.ndarray) -> dict[str, np.ndarray]:
        set_ = tile.dense(at)
        out = set_.copy()
        for s in map(tile.step, ((1, 0, 0), (0, 1, 0), (0, 0, 1))):
            out[at[set_[at + 2 * s]] + s] = True
        return _own(tile, np.flatnonzero(out))

    return Voxels(tiles.settled(a.df.select(*KEY), 2, _CELL, filled, a.parts), a.grid, parts=a.parts)


def _counted(a: Voxels, connectivity: int) -> DataFrame:
    """Set cells with their number of set neighbours."""

    def counted(tile: tiles.Tile, at: np.ndarray) -> dict[str, np.ndarray]:
        set_ = tile.dense(at, dtype=np.int8)
        at = at[tile.holds(tile.cells(at))]
        n = np.zeros(len(at), np.int64)
        for s in steps(connectivity):
            n += set_[at + tile.step(s)]
        return _own(tile, at) | {"n": n}

    return tiles.settled(a.df.select(*KEY), 1, f"{_CELL}, n long", counted, a.parts)


def keep_neighbours(a: Voxels, num: int, connectivity: int) -> Voxels:
    """Cells with at least ``num`` set neighbours."""
    return Voxels(_counted(a, connectivity).where(F.col("n") >= num).select(*KEY), a.grid, parts=a.parts)


def count_neighbours(a: Voxels, connectivity: int) -> Voxels:
    """Number of set neighbours of each set cell; 0 is unset."""
    return Voxels(_counted(a, connectivity).where("n > 0").withColumnRenamed("n", "val"), a.grid, U32, a.parts)


def edges(a: Voxels) -> Voxels:
    """Set cells with some, but not all, of their 26 neighbours set."""
    return Voxels(_counted(a, 26).where("n > 0 AND n < 26").select(*KEY), a.grid, parts=a.parts)


def greater_than(a: Voxels, rhs: float) -> Voxels:
    return Voxels(_valued(a).where(F.col("val") > rhs).select(*KEY), a.grid)


def less_than(a: Voxels, rhs: float) -> Voxels:
    return Voxels(_valued(a).where(F.col("val") < rhs).select(*KEY), a.grid)


def _valued(a: Voxels) -> DataFrame:
    return a.df if a.kind == U32 else a.df.select(*KEY).withColumn("val", F.lit(1).cast("long"))


def shift(a: Voxels, dx: int, dy: int, dz: int) -> Voxels:
    """Cells moved by whole steps; what leaves the extent is dropped, values stay."""
    moved = a.df
    for axis, d in zip(AXES, (dx, dy, dz), strict=True):
        moved = moved.withColumn(axis, F.col(axis) + F.lit(d).cast("long"))
    return a.with_df(moved.where(a.grid.inside()))


def _direction(dx: int, dy: int, dz: int) -> tuple[str, int]:
    given = [(a, d) for a, d in zip(AXES, (dx, dy, dz), strict=True) if d != 0]
    if len(given) != 1:
        raise ValueError("exactly one of dx, dy, dz must be given")
    return given[0]


def sweep(a: Voxels, dx: int = 0, dy: int = 0, dz: int = 0, until: Voxels | None = None, longest: int | None = None) -> Voxels:
    """Cells drawn along one axis: |d| cells with the cell itself (times the value in an integer grid), or, with
    ``until``, up to the cell before the next of those, the extent's end or ``longest`` further steps."""
    axis, d = _direction(dx, dy, dz)
    sign = 1 if d > 0 else -1
    at = AXES.index(axis)
    end = a.grid.hi[at] if sign > 0 else a.grid.lo[at]
    if until is None:
        run = F.lit(abs(d)).cast("long") * (F.col("val") if a.kind == U32 else F.lit(1))
        last = F.col(axis) + sign * (run - 1)
        cells = a.df
    else:
        a.grid.check(until.grid)
        cells = _stops(a, until, axis, sign, longest)
        last = F.coalesce(F.col("_stop") - sign, F.lit(end).cast("long"))
        if longest is not None:
            last = F.least(last, F.col(axis) + longest) if sign > 0 else F.greatest(last, F.col(axis) - longest)
    last = F.least(last, F.lit(end).cast("long")) if sign > 0 else F.greatest(last, F.lit(end).cast("long"))
    swept = cells.withColumn("_last", last).where(F.col("_last") >= F.col(axis) if sign > 0 else F.col("_last") <= F.col(axis))
    swept = swept.select(*(x for x in AXES if x != axis), F.explode(F.sequence(F.col(axis), F.col("_last"), F.lit(sign).cast("long"))).alias(axis)).select(*KEY)
    times = min(8, abs(d) if until is None else 8 if longest is None else longest + 1)
    if a.kind == BIT:
        return Voxels(spread(swept, times, a).distinct(), a.grid, parts=a.parts and a.parts * times)
    # a cell that another's run passes is 1, any other keeps its value
    beyond = cells.withColumn("_last", last).where((F.col("_last") - F.col(axis)) * sign > 0)
    beyond = beyond.select(*(x for x in AXES if x != axis), F.explode(F.sequence(F.col(axis) + sign, F.col("_last"), F.lit(sign).cast("long"))).alias(axis))
    rows = a.df.select(*KEY, "val", F.lit(0).alias("_s")).unionByName(beyond.select(*KEY, F.lit(1).cast("long").alias("val"), F.lit(1).alias("_s")))
    return Voxels(spread(rows, times, a).groupBy(*KEY).agg(F.max_by("val", "_s").alias("val")), a.grid, U32, a.parts and a.parts * times)


#: Cells of an axis that are looked through together for what stops a sweep.
STRETCH = 8192


def _stops(a: Voxels, until: Voxels, axis: str, sign: int, longest: int | None) -> DataFrame:
    """a's cells with ``_stop``, the index of the next cell of ``until`` along the axis; null if there is none, or none that a sweep
    of ``longest`` steps meets."""
    others = [x for x in AXES if x != axis]
    block = F.floor(F.col(axis) / STRETCH)
    stop = until.df.select(*KEY)
    if longest is not None:
        # a stop counts in the stretches from which it can be met
        ends = [F.floor((F.col(axis) - n * sign) / STRETCH) for n in (longest + 1, 0)]
        stop = stop.withColumn("_w", F.explode(F.sequence(F.least(*ends), F.greatest(*ends))))
    else:
        stop = stop.withColumn("_w", block)
    both = a.df.withColumn("_w", block).withColumn("_b", F.lit(False)).unionByName(stop.withColumn("_b", F.lit(True)), allowMissingColumns=True)
    if a.parts:
        both = both.repartition(2 * a.parts, *others, "_w")
    # backwards, a cell before the stop at its own place: of the rows passed, the last stop is the next one
    back = F.col(axis).desc() if sign > 0 else F.col(axis).asc()
    passed = Window.partitionBy(*others, "_w").orderBy(back, "_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = both.withColumn("_stop", F.last(F.when(F.col("_b"), F.col(axis)), ignorenulls=True).over(passed)).where("NOT _b").drop("_b")
    if longest is None:
        first = stop.groupBy(*others, "_w").agg((F.min if sign > 0 else F.max)(axis).alias("_f"))
        steps_ = a.df.select(*others, block.alias("_w")).distinct().join(first, [*others, "_w"], "full")
        far = Window.partitionBy(*others).orderBy(F.col("_w").desc() if sign > 0 else F.col("_w").asc()).rowsBetween(Window.unboundedPreceding, -1)
        beyond = steps_.withColumn("_far", F.last("_f", ignorenulls=True).over(far)).where("_far IS NOT NULL").select(*others, "_w", "_far")
        cells = cells.join(beyond, [*others, "_w"], "left").withColumn("_stop", F.coalesce("_stop", "_far")).drop("_far")
    return cells.drop("_w")


def _runs(a: Voxels) -> DataFrame:
    """Maximal runs along z: (gi, gj, gk, n) with gk the lowest."""
    nth = F.row_number().over(Window.partitionBy("gi", "gj").orderBy("gk"))
    cells = a.df.select(*KEY)
    if a.parts:
        cells = cells.repartition(a.parts, "gi", "gj")
    return cells.withColumn("_g", F.col("gk") - nth).groupBy("gi", "gj", "_g").agg(F.min("gk").alias("gk"), F.count("*").alias("n")).drop("_g")


def _down(dx: int, dy: int, dz: int) -> None:
    if dx or dy or dz >= 0:
        raise ValueError("only (0, 0, <0) is supported")


def collapse(a: Voxels, dx: int = 0, dy: int = 0, dz: int = -1) -> Voxels:
    """The lowest cell of each run along z."""
    _down(dx, dy, dz)
    return Voxels(_runs(a).select(*KEY), a.grid)


def collapse_count(a: Voxels, dx: int = 0, dy: int = 0, dz: int = -1) -> Voxels:
    """The lowest cell of each run along z, with the run's length."""
    _down(dx, dy, dz)
    return Voxels(_runs(a).select(*KEY, F.col("n").alias("val")), a.grid, U32)


def resample(a: Voxels, factor: int) -> Voxels:
    """Cells split into factor^3 smaller ones, or for a negative factor pooled into larger ones that hold any."""
    if factor == 0:
        raise ValueError("factor must not be 0")
    g = a.grid
    cells = a.df.select(*KEY)
    if factor > 0:
        grid = Grid(g.size / factor, g.chunk, tuple(o * factor for o in g.offset), tuple(n * factor for n in g.chunks))
        for axis in AXES:
            lo = F.col(axis) * factor
            cells = cells.withColumn(axis, F.explode(F.sequence(lo, lo + (factor - 1))))
        return Voxels(cells, grid)
    f = -factor
    lo = tuple(o // f for o in g.offset)
    hi = tuple(-(-(o + n) // f) for o, n in zip(g.offset, g.chunks, strict=True))
    grid = Grid(g.size * f, g.chunk, lo, tuple(b - a for a, b in zip(lo, hi, strict=True)))
    return Voxels(cells.select(*(F.floor(F.col(x) / f).alias(x) for x in AXES)).distinct(), grid)


def repeat_slice(a: Voxels, axis: int, location: float, repetitions: int) -> Voxels:
    """The slice that holds ``location`` repeated; greater cells move up, or for a negative number smaller ones down."""
    name, r = AXES[axis], abs(repetitions)
    at = a.grid.lo[axis] + int((location - a.grid.origin[axis]) // a.grid.size)
    more = -(-r // a.grid.chunk)
    offset_, chunks = list(a.grid.offset), list(a.grid.chunks)
    chunks[axis] += more
    if repetitions < 0:
        offset_[axis] -= more
    base = -r if repetitions < 0 else 0
    x = F.col(name)
    low = F.when(x < at, x + base).when(x == at, x + base).otherwise(x + base + r)
    high = F.when(x == at, x + base + r).otherwise(low)
    out = a.df.select(*KEY).withColumn("_s", F.sequence(low, high)).withColumn(name, F.explode("_s")).select(*KEY)
    return Voxels(out, Grid(a.grid.size, a.grid.chunk, tuple(offset_), tuple(chunks)))


def dilate(a: Voxels) -> Voxels:
    """Offset and the cells themselves."""
    return union(a.bits(), offset(a))
