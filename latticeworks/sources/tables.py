"""Grids from ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid, Triple
from ..voxels import BIT, U32, Voxels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cells(rows: DataFrame, i: Column, j: Column, k: Column, lo: Triple, hi: Triple, value: Column | None = None, parts: int | None = None) -> Voxels:
    """A grid of the distinct cells of rows; ``value`` is an aggregate for an integer grid. With ``parts``, rows are dealt over so many tasks."""
    grid = Grid.of_cells(lo, hi)
    keyed = rows.select(*(c.cast("long").alias(a) for c, a in zip((i, j, k), ("gi", "gj", "gk"), strict=True)), *[c for c in rows.columns if c not in ("gi", "gj", "gk")])
    if value is None:
        keyed = keyed.select("gi", "gj", "gk")
    if parts:
        keyed = keyed.repartition(parts, "gi", "gj", "gk")
    if value is None:
        return Voxels(keyed.distinct().where(grid.inside()), grid, BIT, parts)
    return Voxels(keyed.groupBy("gi", "gj", "gk").agg(value.cast("long").alias("val")).where(grid.inside() & (F.col("val") != 0)), grid, U32, parts)


#: Quantity, and discount or tax in hundredths, of the order-line grids, with padding.
QUANTITY, SHARE = (0, 51), (-1, 11)
#: Rows of a task: what it holds is bounded, whatever the number of rows.
ROWS = 250_000


def lines(spark: SparkSession, sf_dir: str, by: str = "l_partkey", third: str = "l_discount", value: Column | None = None) -> Voxels:
    """All order lines by a key that grows with the data, quantity and discount or tax; grids of the same table have one extent."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    # the first axis holds both keys, with one cell of padding on each side
    least, most, n = rows.agg(F.least(F.min("l_partkey"), F.min("l_suppkey")), F.greatest(F.max("l_partkey"), F.max("l_suppkey")), F.count("*")).first()
    lo, hi = (int(least or 0) - 1, QUANTITY[0], SHARE[0]), (int(most or 0) + 1, QUANTITY[1], SHARE[1])
    return cells(rows.select(by, "l_quantity", third), F.col(by), F.floor("l_quantity"), F.round(F.col(third) * 100), lo, hi, value, -(-n // ROWS) or None)


def events(spark: SparkSession, sf_dir: str) -> Voxels:
    """Events by user, quarter of the day and value: a large sparse grid that grows with the data."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    return cells(rows, F.col("user_id"), F.floor(F.hour("ts") / 6), F.floor(F.col("value") / 20), (0, 0, -1000), (1_000_000, 3, 1000))
