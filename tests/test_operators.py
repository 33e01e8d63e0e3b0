"""Small grids with known results."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from latticeworks import Grid, Voxels
from latticeworks.grid import N6, N26, key, unkey
from latticeworks.operators import boolean as B
from latticeworks.operators import morphology as M
from latticeworks.operators import regions as R
from latticeworks.operators import shape, summaries
from latticeworks.operators import surfaces as S


def block(lo, hi):
    return list(itertools.product(*(range(a, b + 1) for a, b in zip(lo, hi, strict=True))))


def grid(n, chunk=10, size=1.0):
    return Grid.spanning((0.0, 0.0, 0.0), size, (n, n, n), chunk)


def test_grid_snaps_to_the_global_raster():
    g = Grid.spanning((15.0, -3.0, 0.0), 1.0, (20, 20, 20), 10)
    assert g.offset == (1, -1, 0) and g.chunks == (3, 3, 2)
    assert g.index(15.5, -0.1, 0) == (15, -1, 0) and g.centre(0, 0, 0) == (0.5, 0.5, 0.5)


def test_packed_keys_round_trip(spark):
    df = spark.createDataFrame([(-5, 7, 0), (1_000_000, -1_000_000, 3)], "gi long, gj long, gk long")
    back = df.select(*(c.alias(n) for c, n in zip(unkey(key(F.col("gi"), F.col("gj"), F.col("gk"))), ("gi", "gj", "gk"), strict=True)))
    assert sorted(back.collect()) == sorted(df.collect())


def test_union_of_two_blocks(spark):
    a = Voxels.cells(spark, block((0, 0, 0), (9, 9, 9)), grid(20))
    b = Voxels.cells(spark, block((10, 10, 10), (19, 19, 19)), Grid.spanning((15.0, 15.0, 15.0), 1.0, (5, 5, 5), 10))
    u = B.union(a, b)
    assert u.count() == 2000 and u.bounds()[1] == (19, 19, 19)
    with pytest.raises(ValueError):
        B.union_in_place(a, b)


def test_plane_differences(spark):
    full = Voxels.full(spark, grid(10))
    z = Voxels.cells(spark, block((0, 0, 0), (9, 9, 0)), grid(10))
    y = Voxels.cells(spark, block((0, 0, 0), (9, 0, 9)), grid(10))
    s = B.subtract(full, z)
    assert s.count() == 900 and s.bounds()[0] == (0, 0, 1)
    assert B.intersect(y, z).count() == 10


def test_mismatched_sizes_are_errors(spark):
    with pytest.raises(ValueError, match="sizes differ"):
        B.union(Voxels.full(spark, grid(10)), Voxels.full(spark, grid(10, size=0.5)))


def test_if_non_empty_returns_the_first(spark):
    a = Voxels.cells(spark, [(1, 1, 1)], grid(10))
    assert B.intersect(a, B.zeros(a), if_non_empty=True) is a


def test_hollow_cube(spark):
    cells = [c for c in block((2, 2, 2), (4, 4, 4)) if c != (3, 3, 3)]
    v = Voxels.cells(spark, cells, grid(3, 10))
    assert (3, 3, 3) in M.fill_gaps(v).collect() and M.fill_gaps(v).count() == 27
    around = M.offset(v).collect()
    assert (1, 1, 1) in around and (3, 3, 3) in around and (2, 2, 2) not in around


def test_point_sweeps(spark):
    v = Voxels.cells(spark, [(1, 1, 1)], grid(100))
    s = M.sweep(v, 0, 0, 5)
    assert s.count() == 5 and M.collapse(s).collect() == [(1, 1, 1)]
    c = M.collapse_count(s)
    assert c.collect() == [(1, 1, 1, 5)] and M.sweep(c, 0, 0, 1).count() == 5
    with pytest.raises(ValueError):
        M.collapse(v, 1, 0, 0)
    with pytest.raises(ValueError):
        M.sweep(v, 1, 1, 0)


def test_sweep_until(spark):
    a, b = Voxels.cells(spark, [(1, 1, 1)], grid(100)), Voxels.cells(spark, [(1, 1, 10)], grid(100))
    assert M.sweep(a, 0, 0, 1, until=b).count() == 9
    assert M.sweep(a, 0, 0, 1, until=b, longest=3).count() == 4


def test_keep_neighbours(spark):
    v = Voxels.cells(spark, block((1, 1, 1), (3, 3, 3)), grid(8, 8))
    assert [M.keep_neighbours(v, n, c).count() for n, c in ((6, 6), (26, 26), (5, 6), (0, 6))] == [1, 1, 7, 27]


def shell():
    inner = set(block((3, 3, 3), (5, 5, 5)))
    return [c for c in block((2, 2, 2), (6, 6, 6)) if c not in inner]


def test_shell_traversal(spark):
    v = Voxels.cells(spark, [*shell(), (4, 4, 4)], grid(10))
    assert v.count() == 99 and R.outmost(v).count() == 98 and R.count_components(v) == 2
    seed = Voxels.cells(spark, [(2, 2, 2)], grid(10))
    assert [R.traverse(v, seed, depth=d).count() for d in (0, 1, 2)] == [1, 4, 10]
    assert R.traverse(v, seed).count() == 98


def test_weighted_traversal(spark):
    v = Voxels.cells(spark, block((2, 2, 2), (6, 6, 6)), grid(10))
    seed = Voxels.cells(spark, [(4, 4, k) for k in (3, 4, 5)], grid(10))
    assert R.traverse(v, seed, depth=3**0.5, connectedness=26).count() == 45
    plate = Voxels.cells(spark, block((2, 2, 4), (6, 6, 4)), grid(10))
    assert R.traverse(plate, Voxels.cells(spark, [(i, 4, 4) for i in (3, 4, 5)], grid(10)), depth=2.0, connectedness=26).count() == 21
    values = R.traverse(plate, Voxels.cells(spark, [(2, 2, 4)], grid(10)), connectedness=26, kind="uint")
    assert (3, 3, 4, 15) in values.collect() and (2, 2, 4, 1) in values.collect()


def test_mixed_seeds_are_an_error(spark):
    v = Voxels.cells(spark, [(1, 1, 1)], grid(10))
    with pytest.raises(ValueError, match="not constant"):
        R.traverse(v, Voxels.cells(spark, [(1, 1, 1), (2, 2, 2)], grid(10)))
    assert R.traverse(v, Voxels.cells(spark, [(2, 2, 2)], grid(10))).count() == 999


def test_resample(spark):
    v = Voxels.full(spark, grid(8, 8))
    assert M.resample(v, -4).count() == 8 and M.resample(v, 2).count() == 4096
    one = Voxels.cells(spark, [(1, 1, 1)], grid(8, 8))
    assert M.resample(one, 2).collect() == sorted(block((2, 2, 2), (3, 3, 3)))


def boxes(spark, n=2, side=5):
    rows = [t for p in range(n) for t in S.box_triangles(p + 1, (1.5 + p * 9, 1.5, 1.5), (1.5 + p * 9 + side, 1.5 + side, 1.5 + side))]
    return S.Surfaces.of(spark, rows)


def test_box_surfaces_and_volumes(spark):
    s = boxes(spark)
    v = S.voxelize(s, 1.0, 16, padding=4)
    n = 6**3 - 4**3
    assert v.count() == 2 * n
    assert R.volume2(v).count() == R.volume(v).count() == 2 * 4**3
    assert R.fill_volume(v).count() == 2 * 6**3 == S.voxelize(s, 1.0, 16, method="volume", padding=4).count()
    assert R.exterior(v).count() == v.grid.dims[0] * v.grid.dims[1] * v.grid.dims[2] - 2 * 6**3
    ids = S.voxelize(s, 1.0, 16, kind="uint", padding=4)
    assert sorted(r["val"] for r in summaries.values(ids).collect()) == [1, 2]
    with pytest.raises(ValueError, match="Unsupported method"):
        S.voxelize(s, 1.0, method="other")


def test_exterior_needs_padding(spark):
    with pytest.raises(ValueError, match="padding"):
        R.exterior(Voxels.cells(spark, [(0, 0, 0)], grid(10)))


def test_nested_component_is_enclosed(spark):
    v = Voxels.cells(spark, [*shell(), (4, 4, 4)], grid(10))
    assert R.volume(v).count() == 27 and R.volume2(v).count() == 26


def test_normals_and_segments_of_a_box(spark):
    cells = [c for c in block((2, 2, 2), (9, 9, 9)) if any(x in (2, 9) for x in c)]
    v = Voxels.cells(spark, cells, grid(12, 4))
    n = {r[:3]: r[3:] for r in shape.normal_estimate(v, 2).collect()}
    x, y, z, curv = n[(2, 5, 5)]
    assert abs(x) > 32000 and curv < 400
    corner = [abs(q) / 32766 for q in n[(2, 2, 2)][:3]]
    assert all(abs(q - 3**-0.5) < 0.02 for q in corner)


def test_dimensionality_of_a_line(spark):
    v = Voxels.cells(spark, [(i, 5, 5) for i in range(10)], grid(10))
    r = shape.dimensionality_estimate(v, max_depth=2).collect()
    assert all(x[3] == 0 and x[4] == 0 and x[5] >= 32765 for x in r)
    with pytest.raises(ValueError):
        shape.dimensionality_estimate(v)


def test_repeat_slice(spark):
    v = Voxels.cells(spark, [(0, 0, k) for k in range(5)], grid(5, 5))
    assert M.repeat_slice(v, 2, 2.5, 3).count() == 8
    down = M.repeat_slice(v, 2, 2.5, -3)
    assert down.count() == 8 and down.bounds()[0] == (0, 0, -3)


def test_random_grids_against_plain_python(spark):
    r = random.Random(4)
    cells = {(r.randrange(8), r.randrange(8), r.randrange(8)) for _ in range(150)}
    v = Voxels.cells(spark, sorted(cells), grid(8, 8))

    def moved(c, s):
        return tuple(a + b for a, b in zip(c, s, strict=True))

    inside = set(block((0, 0, 0), (7, 7, 7)))
    assert set(M.offset(v).collect()) == {moved(c, s) for c in cells for s in N26} & inside - cells
    assert {x[:3]: x[3] for x in M.count_neighbours(v, 26).collect()} == {c: n for c in cells if (n := sum(moved(c, s) in cells for s in N26))}
    for d in (1, 2, 3):
        want = {(i + a, j + b, k) for i, j, k in cells for a in range(-d, d + 1) for b in range(-d, d + 1)} & inside
        assert set(M.offset_xy(v, d).collect()) == want
    label: dict = {}
    for c in sorted(cells):
        if c not in label:
            todo = [c]
            while todo:
                x = todo.pop()
                if x in cells and x not in label:
                    label[x] = c
                    todo += [moved(x, s) for s in N6]
    sizes: dict = {}
    for c in label.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert R.count_components(v) == len(sizes)
    assert R.keep_components(v, 3).count() == sum(n for n in sizes.values() if n >= 3)
    assert [c.count() for c in R.component_iterator(v)][:3] == [sizes[c] for c in sorted(sizes)][:3]


def test_empty_grids(spark):
    v = Voxels.empty(spark, grid(10))
    assert v.bounds() is None and R.exterior(v).count() == 0 and R.volume(v).count() == 0 and M.offset(v).count() == 0
    assert R.outmost(v).count() == 0 and R.count_components(v) == 0 and summaries.info(v)["count"] == 0


def test_immutable_set(spark):
    v = Voxels.cells(spark, [(1, 1, 1)], grid(10))
    w = B.put(2.5, 2.5, 2.5, v)
    assert v.count() == 1 and w.count() == 2 and w.at(2, 2, 2) and w.at_point(2.1, 2.9, 2.0) and not w.at(0, 0, 0)


def test_group_by(spark):
    v = Voxels.cells(spark, [(0, 0, 0), (0, 0, 1), (0, 0, 2)], grid(10))
    g = Voxels.cells(spark, [(0, 0, 0, 7), (0, 0, 1, 7)], grid(10), "u32")
    assert summaries.group_by(v, g, only_counts=True).collect() == [(7, 2)]
    assert sorted(summaries.group_by(v, g, only_counts=True, keep_zero=True).collect()) == [(0, 1), (7, 2)]
