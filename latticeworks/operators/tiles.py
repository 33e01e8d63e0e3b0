"""Tiles: blocks of the lattice that a task holds as dense arrays, with the cells that border on them.

Cells go through one shuffle to their tile and, near its border, to the tiles beside. What reaches no
further than that border (neighbourhoods, dilations) is then settled in the tile; components are made of
the tiles' own by a graph of what meets at the borders, which is far smaller than that of all cells.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import AXES, KEY_BITS, KEY_HALF, Triple, key, steps
from ..settings import join_small, written
from .graph import ALONE, labels, merged

#: Cells of a tile along each axis, and how far around it its task can look.
SIDE, AROUND = 256, 128
_BITS = 9

#: Kinds of rows of components: a run of cells along z, a tile's part of a component, a cell at a border between tiles.
RUN, PART, BORDER = range(3)
_PIECES = "kind int, label long, gi long, gj long, gk long, hi long, hj long, hk long, n long"


def _tile(ti: Column, tj: Column, tk: Column) -> tuple[Column, Column]:
    """Number of a tile, and of the cell within it."""
    at = F.lit(0)
    for a, t in zip(AXES, (ti, tj, tk), strict=True):
        at = at * (1 << _BITS) + (F.col(a) - t * SIDE + AROUND)
    return key(ti, tj, tk).alias("t"), at.cast("int").alias("p")


def dealt(cells: DataFrame, halo: int, parts: int | None, *more: str) -> DataFrame:
    """(t, p, more): the cells of each tile and those up to ``halo`` around it."""
    if not 0 <= halo <= AROUND:
        raise ValueError(f"tiles reach {AROUND} cells at most")
    out = cells
    for a in AXES:
        first, last = (F.floor((F.col(a) + d) / SIDE).cast("long") for d in (-halo, halo))
        out = out.withColumn(f"_t{a}", F.explode(F.sequence(first, last)))
    out = out.select(*_tile(*(F.col(f"_t{a}") for a in AXES)), *more)
    return out.repartition(parts, *(c for c in ("part", "t") if c in out.columns)) if parts else out


def packed(gi: np.ndarray, gj: np.ndarray, gk: np.ndarray) -> np.ndarray:
    """As :func:`key`."""
    return (gi << KEY_BITS[1] + KEY_BITS[2]) | (gj + KEY_HALF[1] << KEY_BITS[2]) | (gk + KEY_HALF[2])


@dataclass
class Tile:
    """Cells as a dense array: ``lo`` is the lattice index of its first corner, ``own`` the tile's extent within it."""

    lo: np.ndarray
    shape: tuple[int, int, int]
    first: np.ndarray  # least and greatest index of the tile itself
    last: np.ndarray
    at: np.ndarray  # place of each row's cell in the flattened array

    @staticmethod
    def of(t: int, p: np.ndarray, pad: int = 0) -> Tile:
        origin = np.array([t >> KEY_BITS[1] + KEY_BITS[2], (t >> KEY_BITS[2] & (1 << KEY_BITS[1]) - 1) - KEY_HALF[1], (t & (1 << KEY_BITS[2]) - 1) - KEY_HALF[2]]) * SIDE
        mask = (1 << _BITS) - 1
        d = [(p >> 2 * _BITS).astype(np.int64), (p >> _BITS & mask).astype(np.int64), (p & mask).astype(np.int64)]
        lo = np.array([x.min() - pad for x in d])
        shape = tuple(int(x.max()) + pad + 1 - int(y) for x, y in zip(d, lo, strict=True))
        at = ((d[0] - lo[0]) * shape[1] + d[1] - lo[1]) * shape[2] + d[2] - lo[2]
        return Tile(origin + lo - AROUND, shape, origin, origin + SIDE - 1, at)

    @staticmethod
    def over(t: int, lo: np.ndarray, hi: np.ndarray) -> Tile:
        """An empty one over those cells of a box that lie in the tile or next to it."""
        origin = Tile.of(t, np.array([AROUND * ((1 << 2 * _BITS) + (1 << _BITS) + 1)])).first
        a, b = np.maximum(lo, origin - 1), np.minimum(hi, origin + SIDE)
        return Tile(a, tuple(int(x) for x in b - a + 1), origin, origin + SIDE - 1, np.empty(0, np.int64))

    def step(self, s: Triple) -> int:
        return (s[0] * self.shape[1] + s[1]) * self.shape[2] + s[2]

    def cells(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rest, k = np.divmod(at, self.shape[2])
        i, j = np.divmod(rest, self.shape[1])
        return i + self.lo[0], j + self.lo[1], k + self.lo[2]

    def holds(self, c: tuple[np.ndarray, ...], less: int = 0) -> np.ndarray:
        """Whether the tile itself, or its inside without so many layers, holds cells."""
        out = np.ones(len(c[0]), bool)
        for x, a, b in zip(c, self.first, self.last, strict=True):
            out &= (x >= a + less) & (x <= b - less)
        return out

    def dense(self, at: np.ndarray, value=True, dtype=bool) -> np.ndarray:
        out = np.zeros(self.shape[0] * self.shape[1] * self.shape[2], dtype)
        out[at] = value
        return out


def forward(connectivity: int) -> list[Triple]:
    """One of each two opposite steps, without those along z."""
    return [s for s in steps(connectivity) if s > (0, 0, 0) and s[:2] != (0, 0)]


def pieces(tile: Tile, at: np.ndarray, connectivity: int, fits: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Rows of :data:`_PIECES` of the components of cells ``at`` (ascending; none at the array's border).

    Neighbours belong together, or only those whose places in ``at`` ``fits`` accepts."""
    n = len(at)
    c = tile.cells(at)
    node = tile.dense(at, np.arange(1, n + 1, dtype=np.int32), np.int32)
    new = np.ones(n, bool)
    new[1:] = at[1:] != at[:-1] + 1  # no row of z ends within the array, so cells in line are neighbours
    run = np.flatnonzero(new)
    label = np.arange(n) if fits else np.repeat(run, np.diff(np.append(run, n)))
    a, b = [], []
    for s in [*forward(connectivity), *([(0, 0, 1)] if fits else [])]:
        other = node[at + tile.step(s)]
        x = np.flatnonzero(other)
        y = other[x] - 1
        if fits:
            ok = fits(x, y)
            x, y = x[ok], y[ok]
        else:
            x, y = label[x], label[y]
            keep = np.ones(len(x), bool)
            keep[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            x, y = x[keep], y[keep]
        a.append(x)
        b.append(y)
    label = merged(label, np.concatenate(a), np.concatenate(b))
    own = tile.holds(c)
    name = packed(*c)[label]
    known = np.bincount(label[own], minlength=n)
    # parts
    least = np.flatnonzero(known)
    box = []
    where = np.flatnonzero(own)
    order = np.argsort(label[where], kind="stable")
    by = where[order]
    starts = np.flatnonzero(np.r_[True, np.diff(label[by]) > 0]) if len(by) else np.empty(0, np.int64)
    for f in (np.minimum, np.maximum):
        box += [f.reduceat(x[by], starts) if len(by) else x[:0] for x in c]
    out = [{"kind": PART, "label": name[least], "n": known[least]} | dict(zip(("gi", "gj", "gk", "hi", "hj", "hk"), box, strict=True))]
    # runs within the tile
    here = where
    if len(here):
        cut = np.ones(len(here), bool)
        cut[1:] = (at[here][1:] != at[here][:-1] + 1) | (label[here][1:] != label[here][:-1])
        first = here[cut]
        last = here[np.r_[np.flatnonzero(cut)[1:] - 1, len(here) - 1]]
        out.append({"kind": RUN, "label": name[first], "gi": c[0][first], "gj": c[1][first], "gk": c[2][first], "hk": c[2][last]})
    edge = np.flatnonzero((~own & (known[label] > 0)) | (own & ~tile.holds(c, 1)))
    out.append({"kind": BORDER, "label": name[edge], "gi": c[0][edge], "gj": c[1][edge], "gk": c[2][edge], "n": own[edge].astype(np.int64)})
    sizes = [len(o["label"]) for o in out]
    full = {"kind": np.repeat(np.array([o["kind"] for o in out], np.int32), sizes)}
    for f in ("label", *AXES, "hi", "hj", "hk", "n"):
        full[f] = np.concatenate([o.get(f, np.zeros(m, np.int64)) for o, m in zip(out, sizes, strict=True)]).astype(np.int64)
    return full


def table(schema: str, columns: dict[str, np.ndarray]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "short": pa.int16(), "double": pa.float64()}
    return pa.table({n: pa.array(columns[n], kinds[k]) for n, k in (f.split() for f in schema.split(", "))})


@dataclass
class Labelled:
    """Components by the parts that tiles have of them. ``raw`` has rows of :data:`_PIECES`, ``names`` (part?, label, root) of labels that aren't
    their component's."""

    raw: DataFrame
    names: DataFrame
    by: list[str]
    tasks: int | None = None

    def of(self, kind: int, *columns: str) -> DataFrame:
        return self.raw.where(F.col("kind") == kind).select(*self.by, *columns)

    def parts(self) -> DataFrame:
        """(part?, local, label, n, lo and hi of each axis) of each tile's part of a component; ``local`` names it."""
        p = self.of(PART, "n", *AXES, "hi", "hj", "hk").withColumn("local", F.col("label"))
        p = join_small(p, self.names, self.by, "left", self.tasks).withColumn("label", F.coalesce("root", "label")).drop("root")
        return p.repartition(self.tasks, "label") if self.tasks else p

    def runs(self) -> DataFrame:
        """(part?, label, gi, gj, k0, k1) of runs of cells, which tiles cut."""
        r = self.of(RUN, "gi", "gj", F.col("gk").alias("k0"), F.col("hk").alias("k1"))
        return join_small(r, self.names, self.by, "left", self.tasks).withColumn("label", F.coalesce("root", "label")).drop("root")

    def runs_of(self, chosen: DataFrame) -> DataFrame:
        """Runs of the parts named by ``chosen`` (part?, local)."""
        r = self.of(RUN, "gi", "gj", F.col("gk").alias("k0"), F.col("hk").alias("k1"))
        return join_small(r, written(chosen.select(*(c for c in self.by if c != "label"), F.col("local").alias("label"))), self.by, "left_semi", self.tasks)


def _joined(raw: DataFrame, by: list[str], tasks: int | None) -> Labelled:
    raw = written(raw)
    more = [c for c in by if c != "label"]
    border = raw.where(F.col("kind") == BORDER)
    mine = border.where("n = 1").select(*more, *AXES, F.col("label").alias("a"))
    other = border.where("n = 0").select(*more, *AXES, F.col("label").alias("b"))
    met = mine.join(other, [*more, *AXES]).where("a <> b")
    if not more:
        return Labelled(raw, labels(met.select("a", "b").distinct()).select(F.col("node").alias("label"), F.col("label").alias("root")).where("label <> root"), by, tasks)
    pair = written(met.select("part", "a", "b").distinct())
    few = pair.limit(ALONE + 1).toArrow()
    if len(few) <= ALONE:
        a, b = (np.stack([few["part"].to_numpy(), few[n].to_numpy()], 1) for n in ("a", "b"))
        node, at = np.unique(np.concatenate([a, b]), axis=0, return_inverse=True)
        own = merged(np.arange(len(node)), at.ravel()[: len(a)], at.ravel()[len(a) :])
        found = {"part": node[:, 0], "label": node[:, 1], "root": node[own, 1]} if len(node) else {n: np.empty(0, np.int64) for n in ("part", "label", "root")}
        return Labelled(raw, raw.sparkSession.createDataFrame(table("part long, label long, root long", found)).where("label <> root"), by, tasks)
    pair = pair.select(F.struct("part", F.col("a").alias("c")).alias("a"), F.struct("part", F.col("b").alias("c")).alias("b"))
    names = labels(pair).select("node.part", F.col("node.c").alias("label"), F.col("label.c").alias("root")).where("label <> root")
    return Labelled(raw, written(names), by, tasks)


def labelled(cells: DataFrame, connectivity: int, parts: int | None = None, values: tuple[str, ...] = (), fits=None) -> Labelled:
    """Components of cells; a component's label is its packed first cell. With ``fits`` (arrays of ``values`` of
    neighbours, two at a time) only neighbours that fit belong together."""

    def run(group: pa.Table) -> pa.Table:
        p = group["p"].to_numpy()
        order = np.argsort(p)
        tile = Tile.of(group["t"][0].as_py(), p, 1)
        held = [group[v].to_numpy().astype(float)[order] for v in values]
        near = (lambda x, y: fits([h[x] for h in held], [h[y] for h in held])) if fits else None
        return table(_PIECES, pieces(tile, tile.at[order], connectivity, near))

    return _joined(dealt(cells, 1, parts, *values).groupBy("t").applyInArrow(run, _PIECES), ["label"], parts)


def unset(cells: DataFrame, boxes: DataFrame, parts: int | None = None) -> Labelled:
    """Components by faces of the cells of boxes (part, i0, i1, j0, j1, k0, k1) that ``cells`` (part, cell) lack."""
    tiled = boxes
    for a in "ijk":
        tiled = tiled.withColumn(f"_t{a}", F.explode(F.sequence(F.floor(F.col(f"{a}0") / SIDE).cast("long"), F.floor(F.col(f"{a}1") / SIDE).cast("long"))))
    bounds = [f"{a}{n}" for a in "ijk" for n in (0, 1)]
    tiled = tiled.select("part", key(*(F.col(f"_t{a}") for a in "ijk")).alias("t"), *bounds)
    own = dealt(cells, 1, parts, "part")
    schema = f"part long, {_PIECES}"

    def run(group: pa.Table, box: pa.Table) -> pa.Table:
        if not len(box):  # cells beside the box's tiles
            return table(schema, {n.split()[0]: np.empty(0, np.int64) for n in schema.split(", ")})
        lo, hi = (np.array([box[f"{a}{n}"][0].as_py() for a in "ijk"]) for n in (0, 1))
        tile = Tile.over(box["t"][0].as_py(), lo, hi)
        room = np.ones(tile.shape, bool)
        if len(group):
            at = Tile.of(box["t"][0].as_py(), group["p"].to_numpy())
            c = [x - o for x, o in zip(at.cells(at.at), tile.lo, strict=True)]
            inside = np.all([(x >= 0) & (x < n) for x, n in zip(c, tile.shape, strict=True)], axis=0)
            room[tuple(x[inside] for x in c)] = False
        # a layer around, so that no neighbour lies outside the array
        room = np.pad(room, 1)
        tile.lo, tile.shape = tile.lo - 1, room.shape
        rows = pieces(tile, np.flatnonzero(room.ravel()), 6)
        return table(schema, rows | {"part": np.full(len(rows["n"]), box["part"][0].as_py())})

    return _joined(own.groupBy("part", "t").cogroup(tiled.groupBy("part", "t")).applyInArrow(run, schema), ["part", "label"], parts)


def settled(cells: DataFrame, halo: int, schema: str, fn: Callable[[Tile, np.ndarray], dict[str, np.ndarray]], parts: int | None = None) -> DataFrame:
    """What ``fn`` makes of each tile and the places of the cells in and around it, none at the array's border of ``halo``."""

    def run(group: pa.Table) -> pa.Table:
        tile = Tile.of(group["t"][0].as_py(), group["p"].to_numpy(), halo)
        return table(schema, fn(tile, np.sort(tile.at)))

    return dealt(cells, halo, parts).groupBy("t").applyInArrow(run, schema)
