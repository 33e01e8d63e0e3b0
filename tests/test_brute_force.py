"""Queries and operators against brute force."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from latticeworks import queries as reference
from latticeworks.grid import N6, N26, Grid
from latticeworks.operators import shape
from latticeworks.operators.shape import SCALE
from latticeworks.plans import pipelines
from latticeworks.settings import ranked
from latticeworks.voxels import NORMAL, Voxels


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """(folder, rows): parts from 150 on; lines of supplier 3 enclose cells."""
    r = random.Random(3)
    rows = [(r.randrange(150, 156), r.randrange(1, 6), float(r.randrange(1, 7)), r.randrange(0, 5) / 100, r.randrange(0, 4) / 100) for _ in range(260)]
    rows += [(155, s, float(q), d / 100, 0.0) for s, q, d in itertools.product((2, 3, 4), (20, 21, 22), (4, 5, 6)) if (s, q, d) != (3, 21, 5)]
    rows.append((None, 1, 2.0, 0.01, 0.01))
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double").write.parquet(f"{at}/lineitem.parquet")
    return at, rows


def grids(rows):
    a, b, c = ({(x[k], int(x[2]), round(x[t] * 100)) for x in rows if x[k] is not None} for k, t in ((0, 3), (0, 4), (1, 3)))
    keys = [k for x in rows for k in x[:2] if k is not None]
    box = set(itertools.product(range(min(keys) - 1, max(keys) + 2), range(0, 52), range(-1, 12)))
    assert a | b | c <= box
    return a, b, c, box


def near(p, steps):
    return {(p[0] + i, p[1] + j, p[2] + k) for i, j, k in steps}


def flood(start, space, steps=N6):
    seen, todo = set(start), list(start)
    while todo:
        for q in near(todo.pop(), steps):
            if q in space and q not in seen:
                seen.add(q)
                todo.append(q)
    return seen


def parts(cells):
    left, out = set(cells), []
    while left:
        out.append(flood({min(left)}, left))
        left -= out[-1]
    return out


def test_queries_equal_brute_force(spark, lines):
    at, rows = lines
    a, b, c, box = grids(rows)
    outside = flood({min(box)}, box - c)
    closed = set()
    for p in parts(c):
        closed |= box - p - flood({min(box)}, box - p)
    want = {
        "union": a | b, "subtract": a - b, "intersect": a & b, "invert": box - a, "offset": ({q for p in a for q in near(p, N26)} & box) - a,
        "keep_neighbours": {p for p in a if len(near(p, N6) & a) >= 2}, "edge_detect": {p for p in a if 0 < len(near(p, N26) & a) < 26},
        "exterior": outside, "volume2": box - c - outside, "volume": closed, "fill_volume": closed | c, "outmost": parts(a)[0], "keep_components": {q for p in parts(a) if len(p) >= 5 for q in p},
    }
    assert closed and want["volume2"]
    for name, cells in want.items():
        got = [tuple(x) for x in reference.QUERIES[name](spark, at).select("gi", "gj", "gk").collect()]
        assert len(got) == len(set(got)) and set(got) == cells, name
    assert reference.QUERIES["count_components"](spark, at).first()[0] == len(parts(a))
    assert {tuple(x) for x in reference.QUERIES["count_neighbours"](spark, at).collect()} == {(*p, n) for p in a if (n := len(near(p, N26) & a))}
    values = {tuple(x) for x in reference.QUERIES["copy"](spark, at).collect()}
    assert values == a


def test_volumes_of_every_component(spark, tmp_path):
    shells = [(s0, set(itertools.product((s0, s0 + 1, s0 + 2), (11, 12, 13), (1, 2, 3))) - {(s0 + 1, 12, 2)}) for s0 in (5, 15)]
    cells = {x for _, s in shells for x in s}
    rows = [(7, s, float(q), d / 100, 0.0) for s, q, d in cells]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    inner = {(6, 12, 2), (16, 12, 2)}
    for name, want in (("volume", inner), ("fill_volume", cells | inner)):
        got = [tuple(x) for x in reference.QUERIES[name](spark, str(tmp_path)).select("gi", "gj", "gk").collect()]
        assert sorted(got) == sorted(want), name


def one_by_one(rows, tolerance, flat, steps):
    """Labels of cells (cell -> normal, curvature), a region after the other."""
    left = {p: v for p, v in rows.items() if v[3] / SCALE <= flat}
    out, n = {}, 0
    while left:
        seed = min(left, key=lambda p: (left[p][3], p))
        normal = left[seed][:3]
        n += 1

        def like(p, normal=normal, left=left):
            return math.acos(min(1.0, abs(sum((x / SCALE) * (y / SCALE) for x, y in zip(left[p][:3], normal, strict=True))))) <= tolerance

        for p in flood({seed}, {p for p in left if p == seed or like(p)}, steps):
            out[p] = n
            del left[p]
    return out


@pytest.mark.parametrize(("alone", "connectedness", "n"), [(10**6, 6, 6), (10**6, 26, 6), (4, 26, 2)])
def test_segments_equal_regions_grown_one_by_one(spark, alone, connectedness, n):
    r = random.Random(8)
    normals = [(32766, 0, 0), (0, 32766, 0), (23169, 23169, 0), (22000, 24000, 0), (-32766, 0, 0)]
    rows = {(i, j, k): (*r.choice(normals), r.choice([0, 5, 5, 100, 400])) for i in range(n) for j in range(n) for k in range(3) if r.random() < 0.8}
    rows |= {(20 + i, 0, 0): (32766, 0, 0, 7) for i in range(5)}
    a = Voxels.cells(spark, [(*p, *v) for p, v in rows.items()], Grid.of_cells((-1, -1, -1), (30, 8, 8)), NORMAL)
    got = {tuple(x[:3]): x["val"] for x in shape.segment(a, 0.2, 0.01, connectedness, alone).df.collect()}
    assert got == one_by_one(rows, 0.2, 0.01, N6 if connectedness == 6 else N26) and len(set(got.values())) > 2


def test_segment_query(spark, lines):
    at, rows = lines
    c = reference.grid_c(spark, at)
    normals = {tuple(x[:3]): tuple(x[3:]) for x in shape.normal_estimate(c, 1).df.select("gi", "gj", "gk", "nx", "ny", "nz", "curv").collect()}
    got = {tuple(x[:3]): x["val"] for x in reference.QUERIES["segment"](spark, at).select("gi", "gj", "gk", "val").collect()}
    assert got == one_by_one(normals, 0.1, 0.01, N26)


def test_component_foreach_calls_the_operator(spark, tmp_path, monkeypatch):
    cells = set(itertools.product((20,), range(1, 6), range(1, 6)))
    rows = [(p, 1, float(q), d / 100, 0.0) for p, q, d in [*cells, (40, 9, 7), *((30, 10, k) for k in range(1, 8))]]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    calls, run = [], reference.R.component_foreach
    monkeypatch.setattr(reference.R, "component_foreach", lambda a, fn: calls.append(a) or run(a, fn))
    assert reference.QUERIES["component_foreach"](spark, str(tmp_path)).first().asDict() == {"cells": 32, "parts": 2, "most": 30}
    assert len(calls) == 1


def test_ranks_need_no_single_task(spark):
    df = spark.createDataFrame([(x * 7919 % 1000, x) for x in range(1000)], "a long, b long").repartition(7)
    assert sorted((r["a"], r["n"]) for r in ranked(df, ["a"], "n").collect()) == [(k, k) for k in range(1000)]
    assert ranked(df.where("false"), ["a"], "n").count() == 0


def drawn(cells, d):
    return {(i, j, k + n * (1 if d > 0 else -1)) for i, j, k in cells for n in range(abs(d))}


def test_ready_made_analyses_of_a_room(spark):
    grid = Grid.of_cells((-1, -1, -1), (12, 12, 9), size=0.25)
    box = set(itertools.product(range(-1, 13), range(-1, 13), range(-1, 10)))
    slab = set(itertools.product(range(1, 11), range(1, 11), (1, 7)))
    wall = {(i, j, k) for i, j in itertools.product(range(1, 11), repeat=2) for k in range(2, 7) if {i, j} & {1, 10} and not (i == 1 and 3 <= j <= 7 and k < 5)}
    door = set(itertools.product((1,), range(3, 8), (2, 3, 4)))
    desk = {(6, 6, 2), (6, 6, 3)}
    solid = slab | wall | desk

    class Room(pipelines.Building):
        def grid(self, include=None, exclude=()):
            cells = {"IfcSlab": slab, "IfcDoor": door}[include[0]] if include else solid if "IfcDoor" in exclude else solid | door
            return Voxels.cells(spark, sorted(cells), grid)

    room = Room(None, size=0.25)
    wide = {(i + x, j + y, k) for i, j, k in solid for x in (-1, 0, 1) for y in (-1, 0, 1)} & box
    air = (drawn(solid, 2) & box) - drawn(wide, -2)
    foot = {(i, j, k + 1) for i, j, k in slab} - slab
    reach = flood((door & foot) - wide, air)
    assert reach and {tuple(x) for x in room.reachable.collect()} == reach
    high = {}
    for i, j, k in reach:
        n = 0
        while n <= pipelines.HIGHEST and (i, j, k + n) not in solid and (i, j, k + n) in box:
            n += 1
        for m in range(n):
            high.setdefault((i, j), set()).add(k + m)
    want = {(i, j, min(ks), len(ks)) for (i, j), ks in high.items()}
    assert {tuple(x) for x in pipelines.headroom(room).collect()} == want
    feet = reach - {(i, j, k + 1) for i, j, k in reach}
    outside = flood({min(box)}, box - solid - door)
    near_feet = ({(i + x, j + y, k) for i, j, k in feet for x in (-1, 0, 1) for y in (-1, 0, 1)} & box) | feet
    start = outside & near_feet
    far, todo = dict.fromkeys(start, 0.0), sorted(start)
    while todo:
        p = todo.pop(0)
        for s in N26:
            q = (p[0] + s[0], p[1] + s[1], p[2] + s[2])
            d = round(far[p] + math.sqrt(sum(x * x for x in s)), 9)
            if q in reach | start and d < far.get(q, math.inf):
                far[q] = d
                todo.append(q)
    want = {(*p, math.floor(10 * d + 1)) for p, d in far.items() if p in feet}
    assert want and {tuple(x) for x in pipelines.evacuation_distance(room).collect()} == want
