"""A voxel grid: a DataFrame of its set cells, and the lattice they lie in."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, ShortType, StructField, StructType

from .grid import AXES, Grid, Triple

BIT, U32, NORMAL = "bit", "u32", "normal"
VALUES = {BIT: [], U32: ["val"], NORMAL: ["nx", "ny", "nz", "curv"]}
BITS = {BIT: 1, U32: 32, NORMAL: 64}


def schema(kind: str) -> StructType:
    cells = [StructField(a, LongType()) for a in AXES]
    return StructType(cells + [StructField(v, LongType() if kind == U32 else ShortType()) for v in VALUES[kind]])


@dataclass(frozen=True)
class Voxels:
    """Set cells (gi, gj, gk), each once; kind ``u32`` has ``val`` (not 0), ``normal`` has quantised nx, ny, nz, curv."""

    df: DataFrame
    grid: Grid
    kind: str = BIT
    #: Tasks to deal the cells over where their number is known to need it; None leaves that to the session.
    parts: int | None = None

    @staticmethod
    def of(df: DataFrame, grid: Grid, kind: str = BIT, distinct: bool = False) -> Voxels:
        """From a DataFrame with at least the kind's columns; cells outside the grid are left out."""
        cols = [F.col(c).cast("long").alias(c) for c in AXES] + [F.col(v).cast("long" if kind == U32 else "short").alias(v) for v in VALUES[kind]]
        df = df.select(*cols).where(grid.inside())
        if kind == U32:
            df = df.where(F.col("val") != 0)
        return Voxels(df.distinct() if distinct else df, grid, kind)

    @staticmethod
    def cells(spark: SparkSession, cells: list[tuple], grid: Grid, kind: str = BIT) -> Voxels:
        """From a list of tuples, for small grids."""
        return Voxels.of(spark.createDataFrame(cells, schema(kind)), grid, kind, distinct=True)

    @staticmethod
    def full(spark: SparkSession, grid: Grid) -> Voxels:
        return Voxels(grid.cells(spark), grid)

    @staticmethod
    def empty(spark: SparkSession, grid: Grid, kind: str = BIT) -> Voxels:
        return Voxels(spark.createDataFrame([], schema(kind)), grid, kind)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def columns(self) -> list[str]:
        return [*AXES, *VALUES[self.kind]]

    def with_df(self, df: DataFrame, **more) -> Voxels:
        return replace(self, df=df, **more)

    def bits(self) -> Voxels:
        """The same cells without values."""
        return Voxels(self.df.select(*AXES), self.grid, parts=self.parts)

    def count(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def bounds(self) -> tuple[Triple, Triple] | None:
        """Least and greatest set index of each axis; None if nothing is set."""
        r = self.df.agg(*(f(a).alias(f"{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in AXES)).first()
        return None if r[0] is None else ((r[0], r[1], r[2]), (r[3], r[4], r[5]))

    def world_bounds(self) -> tuple[tuple[float, ...], tuple[float, ...]] | None:
        """Corners of the box around the set cells, in world units."""
        b = self.bounds()
        return None if b is None else (tuple(x * self.grid.size for x in b[0]), tuple((x + 1) * self.grid.size for x in b[1]))

    def at(self, i: int, j: int, k: int):
        """Value at a cell: whether it is set, or its value (0 or None where unset)."""
        r = self.df.where((F.col("gi") == i) & (F.col("gj") == j) & (F.col("gk") == k)).first()
        if self.kind == BIT:
            return r is not None
        if self.kind == U32:
            return r["val"] if r else 0
        return tuple(x / 32766.0 for x in r[3:]) if r else None

    def at_point(self, x: float, y: float, z: float):
        return self.at(*self.grid.index(x, y, z))

    def with_cell(self, i: int, j: int, k: int) -> Voxels:
        """A grid with one more cell set (value 1)."""
        one = self.spark.createDataFrame([(i, j, k)], schema(BIT))
        if self.kind == U32:
            one = one.withColumn("val", F.lit(1).cast("long"))
            return self.with_df(self.df.join(one.select(*AXES), list(AXES), "left_anti").unionByName(one))
        return self.with_df(self.df.unionByName(one).distinct())

    def collect(self) -> list[tuple]:
        """All rows in index order; for small grids."""
        return sorted(tuple(r) for r in self.df.select(*self.columns).collect())
