"""Polygons on an integer raster: filling, point tests, segment crossings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

Point = tuple[float, float]


def _round(x: float) -> int:
    """Nearest integer, halves away from 0."""
    return math.floor(x + 0.5) if x >= 0 else math.ceil(x - 0.5)


def inside(p: Point, polygon: list[Point]) -> bool:
    """Even-odd test; points on the border count as inside."""
    x, y = p
    odd = False
    for (x0, y0), (x1, y1) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        turn = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
        if turn == 0 and min(x0, x1) <= x <= max(x0, x1) and min(y0, y1) <= y <= max(y0, y1):
            return True
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            odd = not odd
    return odd


def fill(polygon: list[Point]) -> Iterator[tuple[int, int]]:
    """Cells (column, row) of a polygon, border included, row by row."""
    rows = [p[1] for p in polygon]
    edges = list(zip(polygon, polygon[1:] + polygon[:1], strict=True))
    for y in range(math.ceil(min(rows)), math.floor(max(rows)) + 1):
        at = sorted(x0 + (y - y0) * (x1 - x0) / (y1 - y0) for (x0, y0), (x1, y1) in edges if (y0 > y) != (y1 > y))
        cells: set[int] = set()
        for a, b in zip(at[::2], at[1::2], strict=False):
            cells.update(range(_round(a), _round(b) + 1))
        for (x0, y0), (x1, y1) in edges:  # corners and level edges on this row
            if y0 == y1 == y:
                cells.update(range(_round(min(x0, x1)), _round(max(x0, x1)) + 1))
            elif y0 == y:
                cells.add(_round(x0))
        for x in sorted(cells):
            yield x, y


def crossing(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether segments ab and cd cross in a point within both; touching and lying on each other don't count."""

    def side(p: Point, q: Point, r: Point) -> float:
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def filled(polygons: DataFrame) -> DataFrame:
    """Cells (id, i, j) of polygons (id, xs, ys)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                cells = list(fill(list(zip(r.xs, r.ys, strict=True))))
                yield pd.DataFrame({"id": r.id, "i": [c[0] for c in cells], "j": [c[1] for c in cells]})

    return polygons.mapInPandas(run, "id long, i long, j long")
