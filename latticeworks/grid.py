"""Regular lattices that are aligned to one global chunk raster."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("gi", "gj", "gk")
#: Bits of each axis in a packed key; indices lie within half of that on both sides of 0. The first axis grows with the data.
KEY_BITS = (25, 21, 18)
KEY_HALF = tuple(1 << (n - 1) for n in KEY_BITS)

Triple = tuple[int, int, int]


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


@dataclass(frozen=True)
class Grid:
    """Cell size and extent. Indices are global: cell 0 starts at the world's origin,
    so grids of one cell size share a raster and combine by plain equality of indices.
    """

    size: float
    chunk: int
    offset: Triple  # in chunks
    chunks: Triple

    @staticmethod
    def spanning(origin: tuple[float, float, float], size: float, dims: Triple, chunk: int) -> Grid:
        """The grid over ``dims`` cells from ``origin``, grown to whole chunks of the global raster."""
        offset = tuple(math.floor(o / (size * chunk)) for o in origin)
        moved = tuple(math.ceil((o - c * chunk * size) / size) for o, c in zip(origin, offset, strict=True))
        return Grid(size, chunk, offset, tuple(ceil_div(n + m, chunk) for n, m in zip(dims, moved, strict=True)))  # type: ignore[arg-type]

    @staticmethod
    def of_cells(lo: Triple, hi: Triple, size: float = 1.0, chunk: int = 1) -> Grid:
        """The least grid that holds cells lo to hi (inclusive)."""
        first = tuple(math.floor(a / chunk) for a in lo)
        return Grid(size, chunk, first, tuple(math.floor(b / chunk) - a + 1 for a, b in zip(first, hi, strict=True)))  # type: ignore[arg-type]

    @property
    def lo(self) -> Triple:
        """Least index of each axis."""
        return tuple(o * self.chunk for o in self.offset)  # type: ignore[return-value]

    @property
    def hi(self) -> Triple:
        """Greatest index of each axis, inclusive."""
        return tuple((o + n) * self.chunk - 1 for o, n in zip(self.offset, self.chunks, strict=True))  # type: ignore[return-value]

    @property
    def dims(self) -> Triple:
        return tuple(n * self.chunk for n in self.chunks)  # type: ignore[return-value]

    @property
    def origin(self) -> tuple[float, float, float]:
        return tuple(i * self.size for i in self.lo)  # type: ignore[return-value]

    def index(self, *xyz: float) -> Triple:
        """Cell that holds a point."""
        return tuple(math.floor(x / self.size) for x in xyz)  # type: ignore[return-value]

    def centre(self, i: int, j: int, k: int) -> tuple[float, float, float]:
        return tuple((x + 0.5) * self.size for x in (i, j, k))  # type: ignore[return-value]

    def holds(self, cell: Triple) -> bool:
        return all(a <= x <= b for a, x, b in zip(self.lo, cell, self.hi, strict=True))

    def check(self, other: Grid) -> None:
        if abs(self.size - other.size) > 1e-7:
            raise ValueError(f"voxel sizes differ: {self.size} and {other.size}")
        if self.chunk != other.chunk:
            raise ValueError(f"chunk sizes differ: {self.chunk} and {other.chunk}")

    def hull(self, other: Grid) -> Grid:
        """Least grid over both."""
        self.check(other)
        lo = tuple(min(a, b) for a, b in zip(self.offset, other.offset, strict=True))
        hi = tuple(max(a + n, b + m) for a, n, b, m in zip(self.offset, self.chunks, other.offset, other.chunks, strict=True))
        return Grid(self.size, self.chunk, lo, tuple(h - x for h, x in zip(hi, lo, strict=True)))  # type: ignore[arg-type]

    def packable(self) -> None:
        """An error if an index of the extent, or one beside it, doesn't fit a packed key."""
        if any(a - 1 < -h or b + 1 >= h for a, b, h in zip(self.lo, self.hi, KEY_HALF, strict=True)):
            raise ValueError(f"cells {self.lo} to {self.hi} are beyond packed keys of {KEY_BITS} bits")

    def inside(self, *axes: str) -> Column:
        """Whether a row's cell is within the extent."""
        cond = F.lit(True)
        for name, a, b in zip(AXES, self.lo, self.hi, strict=True):
            if not axes or name in axes:
                cond = cond & F.col(name).between(a, b)
        return cond

    def columns(self, spark: SparkSession, lo: Triple | None = None, hi: Triple | None = None) -> DataFrame:
        """(gi, gj) of every column of cells of a box, the whole extent by default."""
        lo, hi = lo or self.lo, hi or self.hi
        ni, nj = max(0, hi[0] - lo[0] + 1), max(0, hi[1] - lo[1] + 1)
        n = spark.range(ni * nj)
        return n.select((F.lit(lo[0]) + F.floor(F.col("id") / max(nj, 1))).cast("long").alias("gi"), (F.lit(lo[1]) + F.col("id") % max(nj, 1)).cast("long").alias("gj"))

    def cells(self, spark: SparkSession, lo: Triple | None = None, hi: Triple | None = None) -> DataFrame:
        """All cells of a box, the whole extent by default; made where they are used."""
        a, b = lo or self.lo, hi or self.hi
        if a[2] > b[2]:
            return self.columns(spark, a, b).withColumn("gk", F.lit(0).cast("long")).where(F.lit(False))
        return self.columns(spark, a, b).withColumn("gk", F.explode(F.sequence(F.lit(a[2]).cast("long"), F.lit(b[2]).cast("long"))))


def key(i: Column, j: Column, k: Column) -> Column:
    """Cell packed into one long, in lexicographic order."""
    return F.shiftleft(i, KEY_BITS[1] + KEY_BITS[2]).bitwiseOR(F.shiftleft(j + KEY_HALF[1], KEY_BITS[2])).bitwiseOR(k + KEY_HALF[2])


def unkey(packed: Column) -> tuple[Column, Column, Column]:
    """The three indices of a packed cell."""
    j, k = ((F.shiftright(packed, s).bitwiseAND(F.lit((1 << n) - 1).cast("long")) - h).cast("long") for s, n, h in ((KEY_BITS[2], KEY_BITS[1], KEY_HALF[1]), (0, KEY_BITS[2], KEY_HALF[2])))
    return F.shiftright(packed, KEY_BITS[1] + KEY_BITS[2]).cast("long"), j, k


#: Neighbour steps that share a face, that lie in one horizontal layer, and all.
N6: list[Triple] = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
N26: list[Triple] = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) != (0, 0, 0)]


def steps(connectivity: int) -> list[Triple]:
    return N6 if connectivity == 6 else N26
