"""Cells far out and across the borders of tiles, and what tasks hold."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from latticeworks.grid import N6, N26, Grid
from latticeworks.operators import boolean as B
from latticeworks.operators import morphology as M
from latticeworks.operators import regions as R
from latticeworks.operators import shape, tiles
from latticeworks.sources import tables
from latticeworks.voxels import NORMAL, Voxels

from .test_brute_force import flood, near, one_by_one, parts

WIDE = Grid.of_cells((240, -20, -9), (280, 20, 9))


def scattered(seed, share):
    r = random.Random(seed)
    return {p for p in itertools.product(range(248, 264), range(-8, 8), range(-4, 4)) if r.random() < share}


def test_cells_beyond_a_million(spark):
    v = Voxels.cells(spark, [(3, 1, 1), (1_200_000, 1, 1), (7_200_000, 1, 1), (7_200_000, 1, 2)], Grid.of_cells((0, 0, 0), (7_200_001, 5, 5)))
    assert R.outmost(v).collect() == [(3, 1, 1)] and R.count_components(v) == 3
    far = Voxels.cells(spark, [(1, 1, 1)], Grid.of_cells((0, 0, 0), (1 << 24, 5, 5)))
    with pytest.raises(ValueError, match="packed"):
        R.count_components(far)


@pytest.mark.parametrize("share", [0.1, 0.35, 0.7])
def test_components_and_floods_across_tiles(spark, share):
    cells = scattered(5, share)
    v = Voxels.cells(spark, sorted(cells), WIDE)
    found = parts(cells)
    assert R.count_components(v) == len(found)
    assert set(R.outmost(v).collect()) == set(found[0])
    assert set(R.keep_components(v, 3).collect()) == {p for q in found if len(q) >= 3 for p in q}
    assert [(c.count(), c.bounds()[0][0], len(c.collect())) for c in itertools.islice(R.component_iterator(v), 2)] == [(len(q), min(q)[0], len(q)) for q in found[:2]]
    lo, hi = ([f(p[a] for p in cells) for a in range(3)] for f in (min, max))
    box = set(itertools.product(*(range(a - 1, b + 2) for a, b in zip(lo, hi, strict=True))))
    outside = flood({min(box)}, box - cells)
    assert set(R.volume2(v).collect()) == box - cells - outside
    closed = set()
    for p in found:
        closed |= box - p - flood({min(box)}, box - p)
    assert set(R.volume(v).collect()) == closed
    if share == 0.35:
        seed = min(found[-1])
        for c, s in ((6, N6), (26, N26)):
            assert set(R.traverse(v, Voxels.cells(spark, [seed], WIDE), connectedness=c).collect()) == flood({seed}, cells, s)


def test_components_need_no_job_each(spark, monkeypatch):
    v = Voxels.cells(spark, [(3 * i, 1, 1) for i in range(20)], Grid.of_cells((0, 0, 0), (99, 5, 5)))
    monkeypatch.setattr(R, "run_cells", None)
    seen = []
    assert R.component_foreach(v, lambda c: seen.append((c.count(), c.bounds()[0][0]))) == 20
    assert seen == [(1, 3 * i) for i in range(20)]


def test_neighbourhoods_within_tiles(spark, monkeypatch):
    cells = scattered(6, 0.5)
    v = Voxels.cells(spark, sorted(cells), WIDE)
    near_normals = {tuple(x[:3]): tuple(x[3:]) for x in shape.normal_estimate(v, 2).collect()}
    spread = {tuple(x[:3]): tuple(x[3:]) for x in shape.dimensionality_estimate(v, 2).collect()}
    # the same from pairs of cells
    monkeypatch.setattr(shape, "NEAR", 0)
    assert near_normals == {tuple(x[:3]): tuple(x[3:]) for x in shape.normal_estimate(v, 2).collect()} and set(near_normals) == cells
    assert spread == {tuple(x[:3]): tuple(x[3:]) for x in shape.dimensionality_estimate(v, 2).collect()}
    monkeypatch.undo()
    monkeypatch.setattr(shape, "reach", None)
    assert shape.normal_estimate(v, 2).count() == len(cells)


def test_morphology_across_tiles(spark):
    cells = scattered(7, 0.3)
    v = Voxels.cells(spark, sorted(cells), WIDE)
    box = set(itertools.product(*(range(a, b + 1) for a, b in zip(WIDE.lo, WIDE.hi, strict=True))))
    assert set(M.offset(v).collect()) == ({q for p in cells for q in near(p, N26)} & box) - cells
    assert set(M.offset_xy(v, 3).collect()) == {(i + x, j + y, k) for i, j, k in cells for x in range(-3, 4) for y in range(-3, 4)} & box
    between = {(i + x, j + y, k + z) for i, j, k in cells for x, y, z in ((1, 0, 0), (0, 1, 0), (0, 0, 1)) if (i + 2 * x, j + 2 * y, k + 2 * z) in cells}
    assert set(M.fill_gaps(v).collect()) == cells | between
    for n in (6, 26):
        assert {x[:3]: x[3] for x in M.count_neighbours(v, n).collect()} == {p: m for p in cells if (m := len(near(p, N6 if n == 6 else N26) & cells))}


def test_segments_of_touching_components_take_one_round(spark, monkeypatch):
    normals = [(32766, 0, 0), (0, 32766, 0), (0, 0, 32766)]
    r = random.Random(9)
    rows = {(i, j, 0): (*normals[i // 2 % 3], r.randrange(9)) for i in range(250, 268) for j in range(4)}
    a = Voxels.cells(spark, [(*p, *x) for p, x in rows.items()], Grid.of_cells((240, -1, -1), (280, 8, 2)), NORMAL)
    calls, run = [], tiles.labelled
    monkeypatch.setattr(tiles, "labelled", lambda *x: calls.append(1) or run(*x))
    got = {tuple(x[:3]): x["val"] for x in shape.segment(a, 0.2, 0.01, 26, 10).df.collect()}
    assert got == one_by_one(rows, 0.2, 0.01, N26) and len(calls) == 1


@pytest.mark.parametrize(("step", "longest"), [(1, None), (-1, None), (1, 4), (-1, 4)])
def test_sweeps_stop_across_stretches(spark, monkeypatch, step, longest):
    monkeypatch.setattr(M, "STRETCH", 8)
    r = random.Random(2)
    a, b = ({(r.randrange(60), r.randrange(2), 0) for _ in range(n)} for n in (40, 12))
    g = Grid.of_cells((0, 0, 0), (59, 1, 1))
    want = set()
    for i, j, k in a:
        x, n = i, 0
        while 0 <= x < 60 and (n == 0 or (x, j, k) not in b) and (longest is None or n <= longest):
            want.add((x, j, k))
            x, n = x + step, n + 1
    va, vb = (Voxels.cells(spark, sorted(c), g) for c in (a, b))
    df = M.sweep(va, dx=step, until=vb, longest=longest).df
    assert {tuple(x) for x in df.collect()} == want
    assert "RangeFrame" not in df._jdf.queryExecution().toString()


def test_tasks_hold_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 50)
    rows = [(i, i % 7 + 1, float(i % 50 + 1), i % 10 / 100, i % 8 / 100) for i in range(1000)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    a, b = tables.lines(spark, str(tmp_path)), tables.lines(spark, str(tmp_path), third="l_tax")
    values = tables.lines(spark, str(tmp_path), value=tables.F.count("*"))
    assert a.df.rdd.getNumPartitions() == 20
    for v, n in ((B.union(a, b), 40), (B.union(values, values), 40), (M.sweep(a, dz=-3), 60), (M.sweep(values, dx=2), 40), (M.collapse(a), 20), (M.collapse_count(a), 20), (M.offset(a), 20), (M.keep_neighbours(a, 2, 6), 20), (M.offset_xy(a, 2), 20)):
        sizes = v.df.rdd.glom().map(len).collect()
        assert len(sizes) >= n and sum(sizes) == v.count() and np.median(sizes) <= 50 * 40
