"""Triangle sets and their discretisation."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import vectors as V
from ..grid import AXES, Grid
from ..settings import written
from ..voxels import BIT, U32, Voxels
from . import regions
from .boolean import KEY

PADDING = 32
EPS = 1e-9
POINT = "struct<x:double,y:double,z:double>"
TRIANGLES = f"product_id bigint, face_id int, tri_id int, v0 {POINT}, v1 {POINT}, v2 {POINT}"


@dataclass(frozen=True)
class Surfaces:
    """Triangles of elements: product_id, face_id, tri_id, v0, v1, v2 (world units), and optionally guid."""

    df: DataFrame

    @staticmethod
    def of(spark: SparkSession, triangles: list[tuple]) -> Surfaces:
        return Surfaces(spark.createDataFrame(triangles, TRIANGLES))

    def count(self) -> int:
        """Number of elements."""
        return self.df.select("product_id").distinct().count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def box(self) -> tuple[tuple[float, ...], tuple[float, ...]] | None:
        r = self.df.agg(*(f(F.greatest(*(F.col(f"v{i}.{n}") for i in range(3))) if f is F.max else F.least(*(F.col(f"v{i}.{n}") for i in range(3)))) for f in (F.min, F.max) for n in V.XYZ)).first()
        return None if r[0] is None else (tuple(r[:3]), tuple(r[3:]))


#: Corner numbers (bits x, y, z) of a box's faces, as quadrilaterals.
BOX_FACES = ((0, 2, 6, 4), (1, 5, 7, 3), (0, 4, 5, 1), (2, 3, 7, 6), (0, 1, 3, 2), (4, 6, 7, 5))


def box_triangles(product_id: int, lo: tuple[float, float, float], hi: tuple[float, float, float]) -> list[tuple]:
    corner = [tuple(float((hi if c >> a & 1 else lo)[a]) for a in range(3)) for c in range(8)]
    out = []
    for f, (a, b, c, d) in enumerate(BOX_FACES):
        out += [(product_id, f, 0, corner[a], corner[b], corner[c]), (product_id, f, 1, corner[a], corner[c], corner[d])]
    return out


def grid_for(s: Surfaces, size: float, chunk: int, padding: int = PADDING) -> Grid | None:
    """The grid around a surface set, with padding cells on every side."""
    box = s.box()
    if box is None:
        return None
    lo, hi = box
    dims = tuple(math.ceil((b - a) / size) + 2 * padding for a, b in zip(lo, hi, strict=True))
    return Grid.spanning(tuple(a - size * padding for a in lo), size, dims, chunk)  # type: ignore[arg-type]


def storage_for(lo: tuple, hi: tuple, most: int, padding: int, chunk: int) -> Grid:
    """A grid over a box whose longest side has ``most`` cells."""
    size = max(b - a for a, b in zip(lo, hi, strict=True)) / most
    dims = tuple(math.ceil((b - a) / size) + 2 * padding for a, b in zip(lo, hi, strict=True))
    return Grid.spanning(tuple(a - size * padding for a in lo), size, dims, chunk)  # type: ignore[arg-type]


def meets(v: np.ndarray, half: float) -> np.ndarray:
    """Whether triangles (n x corner x axis), given around a cube's centre, meet the cube: none of the 13
    axes of the separating-axis theorem parts them."""
    ok = (v.min(1) <= half).all(1) & (v.max(1) >= -half).all(1)
    edges = np.stack([v[:, 1] - v[:, 0], v[:, 2] - v[:, 1], v[:, 0] - v[:, 2]], 1)
    normal = np.cross(edges[:, 0], edges[:, 1])
    ok &= np.abs((normal * v[:, 0]).sum(1)) <= half * np.abs(normal).sum(1)
    for n in range(3):
        for a in np.eye(3):
            axis = np.cross(a, edges[:, n])
            on = (v * axis[:, None]).sum(2)
            reach = half * np.abs(axis).sum(1)
            ok &= (on.min(1) <= reach) & (on.max(1) >= -reach)
    return ok


def touched(s: Surfaces, grid: Grid, eps: float = EPS) -> DataFrame:
    """(product_id, face_id, cell) of all cells that a triangle touches.

    Candidates are the cells of each triangle's box; long triangles make many, so
    rows are dealt out again between the slabs of x and the cells of a slab."""
    d = grid.size
    t = s.df.select("product_id", "face_id", "v0", "v1", "v2")
    for axis, n in zip(AXES, V.XYZ, strict=True):
        lo, hi = F.least(*(F.col(f"v{i}.{n}") for i in range(3))), F.greatest(*(F.col(f"v{i}.{n}") for i in range(3)))
        first, last = F.greatest(F.floor(lo / d) - 1, F.lit(grid.lo[AXES.index(axis)])), F.least(F.floor(hi / d) + 1, F.lit(grid.hi[AXES.index(axis)]))
        t = t.withColumn(f"{axis}0", first).withColumn(f"{axis}1", last)
    t = t.where("gi0 <= gi1 AND gj0 <= gj1 AND gk0 <= gk1")
    t = t.withColumn("gi", F.explode(F.sequence("gi0", "gi1"))).repartition("product_id", "face_id", "gi")
    t = t.withColumn("gj", F.explode(F.sequence("gj0", "gj1"))).withColumn("gk", F.explode(F.sequence("gk0", "gk1")))
    half = d / 2 + eps

    @F.pandas_udf(BooleanType())
    def hit(*cols: pd.Series) -> pd.Series:
        points = np.stack([c.to_numpy(float) for c in cols[:9]], 1).reshape(-1, 3, 3)
        centre = (np.stack([c.to_numpy(float) for c in cols[9:]], 1) + 0.5) * d
        return pd.Series(meets(points - centre[:, None], half))

    corners = [F.col(f"v{i}.{n}") for i in range(3) for n in V.XYZ]
    return t.where(hit(*corners, *KEY)).select("product_id", "face_id", *KEY).distinct()


def voxelize(s: Surfaces, size: float, chunk: int = 128, kind: str = "bit", method: str = "surface", padding: int = PADDING, grid: Grid | None = None) -> Voxels:
    """Cells that surfaces touch, or with method ``volume`` also those each element encloses; for any other
    kind than ``bit`` the greatest product id of the elements whose volume holds the cell."""
    if method not in ("surface", "volume"):
        raise ValueError(f"Unsupported method {method}")
    grid = grid or grid_for(s, size, chunk, padding)
    spark = s.df.sparkSession
    if grid is None:
        return Voxels.empty(spark, Grid(size, chunk, (0, 0, 0), (1, 1, 1)), BIT if kind == "bit" else U32)
    if kind == "bit" and method == "surface":
        return Voxels(touched(s, grid).select(*KEY).distinct(), grid)
    by_element = element_volumes(touched(s, grid).select("product_id", *KEY).distinct())
    if kind == "bit":
        return Voxels(by_element.select(*KEY).distinct(), grid)
    return Voxels(by_element.groupBy(*KEY).agg(F.max("product_id").alias("val")).where("val <> 0"), grid, U32)


def element_volumes(cells: DataFrame) -> DataFrame:
    """(product_id, cell): each element's cells and those that they enclose, all elements in one flood."""
    cells = written(cells.select("product_id", *KEY))
    inner = regions.enclosed(cells.withColumnRenamed("product_id", "part"))
    return cells.unionByName(inner.withColumnRenamed("part", "product_id"))


def _clipped(corners: list[tuple[float, float, float]], a: float, b: float, c: float, d: float) -> list[tuple]:
    """Polygon in which a plane cuts a box (corners numbered by bits), in order around its centre."""
    value = [a * x + b * y + c * z + d for x, y, z in corners]
    points = []
    for i in range(8):
        if value[i] == 0:
            points.append(corners[i])
        for axis in range(3):
            j = i | 1 << axis
            if j > i and value[i] * value[j] < 0:
                t = value[i] / (value[i] - value[j])
                points.append(tuple(p + t * (q - p) for p, q in zip(corners[i], corners[j], strict=True)))
    points = list(dict.fromkeys(points))
    if len(points) < 3:
        return []
    p, n = np.array(points), np.array([a, b, c], float)
    middle = p.mean(0)
    u = np.cross(n, [1, 0, 0] if abs(n[0]) < 0.9 * np.linalg.norm(n) else [0, 1, 0])
    u /= np.linalg.norm(u)
    w = np.cross(n / np.linalg.norm(n), u)
    angle = np.arctan2((p - middle) @ w, (p - middle) @ u)
    return [tuple(map(float, points[i])) for i in np.argsort(angle)]


def plane(v: Voxels, a: float, b: float, c: float, d: float) -> Surfaces | Voxels:
    """The plane ax + by + cz + d = 0 within the set cells' box; of an empty grid the grid."""
    box = v.world_bounds()
    if box is None:
        return v
    corners = [tuple(float(box[i >> n & 1][n]) for n in range(3)) for i in range(8)]
    polygon = _clipped(corners, a, b, c, d)
    return Surfaces.of(v.spark, [(0, 0, i, polygon[0], polygon[i + 1], polygon[i + 2]) for i in range(len(polygon) - 2)])


def halfspace(v: Voxels, a: float, b: float, c: float, d: float) -> Surfaces | Voxels:
    """The border of the part of the set cells' box where ax + by + cz + d <= 0."""
    box = v.world_bounds()
    if box is None:
        return v
    corners = [tuple(float(box[i >> n & 1][n]) for n in range(3)) for i in range(8)]

    def value(p: tuple) -> float:
        return a * p[0] + b * p[1] + c * p[2] + d

    faces = []
    for quad in BOX_FACES:
        ring, kept = [corners[i] for i in quad], []
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            if value(p) <= 0:
                kept.append(p)
            if value(p) * value(q) < 0:
                t = value(p) / (value(p) - value(q))
                kept.append(tuple(x + t * (y - x) for x, y in zip(p, q, strict=True)))
        faces.append(kept)
    faces.append(_clipped(corners, a, b, c, d))
    rows = [(0, f, i, p[0], p[i + 1], p[i + 2]) for f, p in enumerate(faces) for i in range(len(p) - 2)]
    return Surfaces.of(v.spark, rows)


def local_copies(s: Surfaces, dx: float, dy: float, dz: float, size: float, only_last: bool = False) -> Surfaces:
    """Copies moved along (dx, dy, dz): the element itself and every step to the end, or only the end.

    A step is the whole vector times its share of the vector's length, so that the
    end lies at the vector times its length (as the described behaviour has it)."""
    length = math.sqrt(dx * dx + dy * dy + dz * dz)
    n = math.ceil(length / size)
    step = length / n if n else 0.0
    nth = F.array(F.lit(n)) if only_last else F.sequence(F.lit(0), F.lit(n))
    moved = s.df.withColumn("_i", F.explode(nth))
    by = V.vec(F.lit(dx) * step * F.col("_i"), F.lit(dy) * step * F.col("_i"), F.lit(dz) * step * F.col("_i"))
    moved = moved.withColumn("tri_id", F.col("tri_id") * (n + 1) + F.col("_i"))
    return replace(s, df=moved.withColumns({f"v{i}": V.add(F.col(f"v{i}"), by) for i in range(3)}).drop("_i"))


def overlap(s: Surfaces, v: Voxels, factor: int = 2, individual_faces: bool = True, face_count: int = 3) -> DataFrame:
    """(product_id) of elements that overlap the voxels: each face counts if it has cells and factor times those
    within the voxels are at least all; an element counts with more than ``face_count`` such faces, or, taken
    as a whole, by itself."""
    cells = touched(s, v.grid).join(v.df.select(*KEY).withColumn("_in", F.lit(1)), KEY, "left")
    if not individual_faces:
        whole = cells.select("product_id", *KEY, "_in").distinct().groupBy("product_id").agg(F.count("*").alias("n"), F.count("_in").alias("m"))
        return whole.where(F.col("m") * factor >= F.col("n")).select("product_id")
    faces = cells.groupBy("product_id", "face_id").agg(F.count("*").alias("n"), F.count("_in").alias("m")).where(F.col("m") * factor >= F.col("n"))
    return faces.groupBy("product_id").agg(F.count("*").alias("n")).where(F.col("n") > face_count).select("product_id")


def matching(s: Surfaces, v: Voxels, factor: int = 2) -> Surfaces:
    """The faces that overlap the voxels."""
    cells = touched(s, v.grid).join(v.df.select(*KEY).withColumn("_in", F.lit(1)), KEY, "left")
    faces = cells.groupBy("product_id", "face_id").agg(F.count("*").alias("n"), F.count("_in").alias("m")).where(F.col("m") * factor >= F.col("n"))
    return Surfaces(s.df.join(faces.select("product_id", "face_id"), ["product_id", "face_id"], "left_semi"))


def ray_hits(v: Voxels, start: tuple[float, float, float], direction: tuple[float, float, float]) -> int:
    """Set cells that a ray passes until it leaves the set cells' box."""
    bounds = v.bounds()
    if bounds is None:
        return 0
    d = v.grid.size
    walk = np.array(direction, float) / np.linalg.norm(direction)
    at, cells = np.array(start, float), []
    lo, hi = np.array(bounds[0]), np.array(bounds[1])
    reach = np.linalg.norm((hi - lo + 1) * d) + np.linalg.norm(at - (lo + hi + 1) / 2 * d)
    crossings = [0.0]
    for x, w in zip(at, walk, strict=True):
        if w:
            ends = sorted((math.floor(x / d), math.floor((x + w * reach) / d)))
            crossings += [(i * d - x) / w for i in range(ends[0], ends[1] + 2) if (i * d - x) / w > 0]
    crossings = sorted(t for t in crossings if t <= reach)
    for a, b in zip(crossings, crossings[1:], strict=False):
        cells.append(tuple(int(i) for i in np.floor((at + walk * (a + b) / 2) / d)))
    ray = v.spark.createDataFrame(list(dict.fromkeys(cells)) or [(0, 0, 0)], "gi long, gj long, gk long")
    return v.df.join(F.broadcast(ray), KEY, "left_semi").count() if cells else 0
