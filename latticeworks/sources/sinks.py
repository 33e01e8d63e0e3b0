"""Writers: CSV, point clouds, meshes, JSON, Parquet."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import AXES, N6
from ..operators.boolean import KEY
from ..operators.regions import components
from ..operators.surfaces import Surfaces
from ..settings import ranked
from ..voxels import NORMAL, U32, Voxels


def csv_rows(a: Voxels) -> DataFrame:
    """x, y, z of each cell's lower corner, then its values; in index order."""
    place = [(F.col(x) * a.grid.size).alias(n) for x, n in zip(AXES, "xyz", strict=True)]
    more = ["val"] if a.kind == U32 else [(F.col(n) / 32766.0).alias(n) for n in ("nx", "ny", "nz", "curv")] if a.kind == NORMAL else []
    return a.df.orderBy(*KEY).select(*place, *more)


def export_csv(a: Voxels, path: str) -> None:
    """A CSV folder without header, sorted over all parts."""
    csv_rows(a).write.mode("overwrite").csv(path)


def export_point_cloud(a: Voxels, path: str) -> None:
    """Lines ``v x y z``, as text parts."""
    rows = csv_rows(a)
    rows.select(F.concat_ws(" ", F.lit("v"), "x", "y", "z")).write.mode("overwrite").text(path)


def faces(a: Voxels, mode: str = "components", groups: Voxels | None = None) -> DataFrame:
    """Border squares: (name, cell, axis, side). Modes: ``plain``, ``components``, ``values`` (between unlike values), ``groups``."""
    own = a.df.select(*KEY, F.col("val") if a.kind == U32 and mode == "values" else F.lit(1).cast("long").alias("val"))
    table = F.array(*(F.struct(*(F.lit(x).cast("long").alias(n) for x, n in zip(s, "ijk", strict=True)), F.lit(i // 2).alias("axis"), F.lit(sum(s)).alias("side")) for i, s in enumerate(N6)))
    around = own.withColumn("_s", F.explode(table))
    near = around.select(*KEY, "val", "_s.axis", "_s.side", *((F.col(x) + F.col(f"_s.{n}")).alias(f"n{x}") for x, n in zip(AXES, "ijk", strict=True)))
    other = own.select(*(F.col(x).alias(f"n{x}") for x in AXES), F.col("val").alias("other"))
    if mode != "values":
        border = near.join(other.drop("other"), [f"n{x}" for x in AXES], "left_anti").select(*KEY, "axis", "side")
        if mode == "components":
            found = components(a)
            numbered = ranked(found.select("label").distinct(), ["label"], "_n").select("label", F.concat(F.lit("component"), "_n").alias("name"))
            return border.join(found.join(numbered, "label").drop("label"), KEY)
        if mode == "groups":
            if groups is None or groups.kind != U32:
                raise ValueError("groups must be a 32-bit grid")
            return border.join(groups.df.select(*KEY, F.concat(F.lit("id-"), "val").alias("name")), KEY)
        return border.withColumn("name", F.lit("all"))
    met = near.join(other, [f"n{x}" for x in AXES], "left").withColumn("other", F.coalesce("other", F.lit(0)))
    met = met.where((F.col("val") != F.col("other")) & ((F.col("other") == 0) | (F.col("side") == 1)))
    return met.select(*KEY, "axis", "side", F.concat_ws("-", F.least("val", "other"), F.greatest("val", "other")).alias("name"))


def triangles(border: DataFrame, size: float) -> DataFrame:
    """(name, square, tri, corner, cx, cy, cz): two triangles for each square, corners as raster points, outward."""
    ring = {1: [(0, 0), (1, 0), (1, 1), (0, 0), (1, 1), (0, 1)], -1: [(0, 0), (1, 1), (1, 0), (0, 0), (0, 1), (1, 1)]}
    rows = [F.struct(F.lit(axis).alias("axis"), F.lit(side).alias("side"), F.lit(n // 3).alias("tri"), F.lit(n % 3).alias("corner"), F.lit(u).alias("u"), F.lit(w).alias("w")) for axis in range(3) for side in (1, -1) for n, (u, w) in enumerate(ring[side])]
    each = border.withColumn("_t", F.explode(F.filter(F.array(*rows), lambda t: (t["axis"] == F.col("axis")) & (t["side"] == F.col("side")))))
    step = F.when(F.col("side") == 1, 1).otherwise(0)
    place = []
    for n in range(3):
        u = (n - 1) % 3  # this axis is the first after the square's in turn, or else the second
        place.append((F.col(AXES[n]) + F.when(F.col("axis") == n, step).when(F.col("axis") == u, F.col("_t.u")).otherwise(F.col("_t.w"))).alias(f"c{n}"))
    return each.select("name", *KEY, "axis", "side", "_t.tri", "_t.corner", *place)


def mesh(a: Voxels, path: str, mode: str = "components", groups: Voxels | None = None, normals: bool = False) -> None:
    """An OBJ file of the border; groups are named, corners are shared. Written by the driver in a stream."""
    corner = triangles(faces(a, mode, groups), a.grid.size)
    points = corner.groupBy("c0", "c1", "c2").agg(*(F.sum(F.when(F.col("axis") == n, F.col("side")).otherwise(0)).alias(f"n{n}") for n in range(3)))
    numbered = ranked(points, ["c0", "c1", "c2"], "id").withColumn("id", F.col("id") + 1)
    with Path(path).open("w") as out:
        size = a.grid.size
        for p in numbered.orderBy("id").toLocalIterator():
            out.write(f"v {p['c0'] * size} {p['c1'] * size} {p['c2'] * size}\n")
        if normals:
            for p in numbered.orderBy("id").toLocalIterator():
                n = (p["n0"] ** 2 + p["n1"] ** 2 + p["n2"] ** 2) ** 0.5 or 1.0
                out.write(f"vn {p['n0'] / n} {p['n1'] / n} {p['n2'] / n}\n")
        square = ["name", *KEY, "axis", "side", "tri"]
        tri = corner.join(numbered.select("c0", "c1", "c2", "id"), ["c0", "c1", "c2"]).groupBy(*square).agg(F.array_sort(F.collect_list(F.struct("corner", "id"))).alias("p"))
        last = None
        for t in tri.orderBy(*square).toLocalIterator():
            if t["name"] != last:
                last = t["name"]
                out.write(f"g {last}\n")
            ids = [x["id"] for x in t["p"]]
            out.write("f " + " ".join(f"{i}//{i}" if normals else str(i) for i in ids) + "\n")


def stats(values: dict) -> dict:
    """JSON values of variables; the counts of all grids in one job."""
    grids = {k: v for k, v in values.items() if isinstance(v, Voxels)}
    counts: dict = {}
    if grids:
        parts = [v.df.agg(F.count("*").alias("n")).withColumn("k", F.lit(k)) for k, v in grids.items()]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        counts = {r["k"]: r["n"] for r in every.collect()}  # one row for each variable
    out: dict = {}
    for k, v in values.items():
        if isinstance(v, Voxels):
            out[k] = {"count": counts[k]}
        elif isinstance(v, Surfaces):
            out[k] = {"num_geometries": v.count()}
        elif hasattr(v, "num_files"):
            out[k] = {"num_files": v.num_files}
        else:
            out[k] = v
    return out


def write_json(value, path: str) -> None:
    Path(path).write_text(json.dumps(value))


def save(a: Voxels, path: str) -> None:
    """A grid as Parquet, with its lattice beside it."""
    a.df.write.mode("overwrite").parquet(f"{path}/cells")
    g = a.grid
    a.spark.createDataFrame([(a.kind, g.size, g.chunk, list(g.offset), list(g.chunks))], "kind string, size double, chunk int, offset array<long>, chunks array<long>").coalesce(1).write.mode("overwrite").parquet(f"{path}/grid")


def load(spark, path: str) -> Voxels:
    """A grid that :func:`save` wrote."""
    from ..grid import Grid

    r = spark.read.parquet(f"{path}/grid").first()
    return Voxels(spark.read.parquet(f"{path}/cells"), Grid(r["size"], r["chunk"], tuple(r["offset"]), tuple(r["chunks"])), r["kind"])
