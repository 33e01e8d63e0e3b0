"""Counts, bounds and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import AXES
from ..voxels import BITS, U32, Voxels
from .boolean import KEY
from .regions import component_sizes


def fmt(v) -> str:
    return "(" + ", ".join(str(x) for x in v) + ")"


def box_columns() -> list:
    return [f(a).alias(f"{n}_{a[1]}") for n, f in (("lo", F.min), ("hi", F.max)) for a in AXES]


def group_by(a: Voxels, groups: Voxels, only_counts: bool = False, keep_zero: bool = False) -> DataFrame:
    """(id, count[, box]) of a's cells by the value of ``groups`` there; cells without a value are group 0 if kept."""
    if groups.kind != U32:
        raise ValueError("groups must be a 32-bit grid")
    if a.grid.offset != groups.grid.offset:
        raise ValueError("grid offsets differ")
    found = a.df.select(*KEY).join(groups.df.select(*KEY, F.col("val").alias("id")), KEY, "left" if keep_zero else "inner")
    extra = [] if only_counts else box_columns()
    return found.withColumn("id", F.coalesce("id", F.lit(0))).groupBy("id").agg(F.count("*").alias("count"), *extra)


def values(a: Voxels) -> DataFrame:
    """Distinct values in ascending order."""
    return (a.df if a.kind == U32 else a.df.withColumn("val", F.lit(1).cast("long"))).select("val").distinct().orderBy("val")


def _described(a: Voxels, count: int, lo: tuple | None, hi: tuple | None) -> dict:
    """Count, extent and, of set cells, their bounds in cells of the extent and in world units."""
    g = a.grid
    last = tuple(o + n - 1 for o, n in zip(g.offset, g.chunks, strict=True))
    out = {"count": count, "grid": f"{fmt(g.offset)} - {fmt(last)}"}
    if count:
        out["bounds"] = f"{fmt(x - o for x, o in zip(lo, g.lo, strict=True))} - {fmt(x - o for x, o in zip(hi, g.lo, strict=True))}"
        out["world"] = f"{fmt(x * g.size for x in lo)} - {fmt(x * g.size for x in hi)}"
    return out | {"bits": BITS[a.kind], "chunk_size": g.chunk}


def info(a: Voxels) -> dict:
    """Count, extent, bounds and so on of a grid, in one aggregation."""
    extra = [F.min("val"), F.max("val")] if a.kind == U32 else []
    r = a.df.agg(F.count("*"), *box_columns(), *extra).first()
    out = _described(a, r[0], r[1:4], r[4:7])
    if a.kind == U32:
        out |= {"min_value": r[7], "max_value": r[8]}
    return out


def components_info(a: Voxels) -> list[dict]:
    """One entry for each component in order, with what :func:`info` says of a bit grid of its cells."""
    rows = component_sizes(a).orderBy("label").toLocalIterator()
    return [_described(a.bits(), r["count"], (r["lo_i"], r["lo_j"], r["lo_k"]), (r["hi_i"], r["hi_j"], r["hi_k"])) for r in rows]
