"""Ready-made analyses of building models, composed of operators; each returns the grid or elements that it is named for."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..functions.lengths import in_cells
from ..operators import boolean as B
from ..operators import morphology as M
from ..operators import regions as R
from ..operators import surfaces as S
from ..sources import ifc, sinks
from ..voxels import Voxels

#: Types that are no obstacle to people, cells of a chunk, cell size in metres.
PASSABLE = ("IfcOpeningElement", "IfcDoor", "IfcSpace")
CHUNK, SIZE = 16, 0.1
#: Height of an obstacle above the floor and room beside it (metres), and cells of height looked at.
STEP, BESIDE, HIGHEST = 0.5, 0.1, 60


@dataclass(frozen=True)
class Building:
    """A model's grids, all on one raster, made when they are asked for."""

    files: ifc.Files
    size: float = SIZE
    chunk: int = CHUNK

    def grid(self, **types) -> Voxels:
        return S.voxelize(ifc.create_geometry(self.files, **types), self.size, self.chunk)

    def cells(self, metres: float) -> int:
        return in_cells(metres, self.size)

    @cached_property
    def solid(self) -> Voxels:
        return self.grid(exclude=PASSABLE)

    @cached_property
    def reachable(self) -> Voxels:
        """Air up to ``STEP`` over something solid, not beside an obstacle, that connects to a door's foot."""
        floors = self.grid(include=["IfcSlab"])
        wide = M.offset_xy(self.solid, self.cells(BESIDE))
        air = B.subtract(M.sweep(self.solid, dz=self.cells(STEP)), M.sweep(wide, dz=-self.cells(STEP)))
        on_floor = B.subtract(M.shift(floors, 0, 0, 1), floors)
        at_doors = B.intersect(self.grid(include=["IfcDoor"]), on_floor)
        return R.traverse(air, B.subtract(at_doors, wide))


def building(spark: SparkSession, pattern: str, size: float = SIZE, chunk: int = CHUNK) -> Building:
    return Building(ifc.parse(spark, pattern), size, chunk)


def exterior_elements(b: Building) -> DataFrame:
    """(guid) of elements a quarter of whose cells at least border on the outside."""
    surfaces = ifc.create_geometry(b.files)
    shell = M.offset(R.exterior(S.voxelize(surfaces, b.size, b.chunk)))
    ids = S.overlap(surfaces, shell, factor=4, individual_faces=False)
    return b.files.elements.join(ids, "product_id", "left_semi").select("guid")


def headroom(b: Building) -> Voxels:
    """Cells over each reachable place up to what is above, ``HIGHEST`` at most, as counts in the lowest one."""
    space = M.sweep(b.reachable, dz=1, until=b.solid, longest=HIGHEST)
    return M.collapse_count(space)


def evacuation_distance(b: Building) -> Voxels:
    """Walking distance from the outside over reachable floor, in tenths of cells plus one."""
    everything = b.grid(exclude=["IfcSpace", "IfcOpeningElement"])
    feet = B.subtract(b.reachable, M.shift(b.reachable, 0, 0, 1))
    ways_out = B.intersect(R.exterior(everything), B.union(M.offset_xy(feet, 1), feet))
    walked = R.traverse(B.union(b.reachable, ways_out), ways_out, connectedness=26, kind="uint")
    return B.intersect(walked, feet)


def written(grid: Voxels, path: str) -> None:
    sinks.export_csv(grid, path)
