"""Operations of the script language: names, argument types and what they run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from ..functions.lengths import in_cells, in_world
from ..operators import boolean as B
from ..operators import morphology as M
from ..operators import regions as R
from ..operators import shape, summaries
from ..operators import surfaces as S
from ..sources import ifc, sinks
from ..voxels import Voxels


@dataclass(frozen=True)
class Arg:
    name: str
    types: frozenset[str]
    required: bool = True


@dataclass(frozen=True)
class Operation:
    name: str
    args: tuple[Arg, ...]
    run: Callable[[Scope], Any]
    catch_all: bool = False
    only_local: bool = False


@dataclass
class Scope:
    """Bound arguments; missing optional ones are looked up in the caller's variables of the same name."""

    spark: SparkSession
    own: dict[str, Any]
    around: dict[str, Any] = field(default_factory=dict)
    call: Callable[[str, dict[str, Any]], Any] | None = None

    def __getitem__(self, name: str) -> Any:
        if name in self.own:
            return self.own[name]
        if name in self.around:
            return self.around[name]
        raise KeyError(f"Undefined variable {name}")

    def get(self, name: str, default: Any = None) -> Any:
        try:
            return self[name]
        except KeyError:
            return default

    def cells(self, name: str, default: int | None = None) -> int | None:
        v = self.get(name)
        return default if v is None else in_cells(v, self["VOXELSIZE"])

    def world(self, name: str, default: float | None = None) -> float | None:
        v = self.get(name)
        return default if v is None else in_world(v, self["VOXELSIZE"])


REGISTRY: dict[str, Operation] = {}


def operation(spec: str, name: str | None = None, **flags: bool):
    """Registers a function; ``spec`` lists ``name:type|type``, optional ones with a question mark after the name."""
    args = []
    for part in spec.split():
        n, _, types = part.partition(":")
        args.append(Arg(n.rstrip("?"), frozenset(types.split("|")), not n.endswith("?")))

    def add(f: Callable[[Scope], Any]) -> Callable[[Scope], Any]:
        own = name or f.__name__.rstrip("_")
        REGISTRY[own] = Operation(own, tuple(args), f, **flags)
        return f

    return add


def lookup(name: str) -> Operation:
    if name not in REGISTRY:
        raise KeyError(f"No operation named {name}")
    return REGISTRY[name]


@operation("input:string")
def parse(s: Scope):
    return ifc.parse(s.spark, s["input"])


@operation("input:ifcfile include?:sequence exclude?:sequence optional?:integer only_transparent?:integer only_opaque?:integer")
def create_geometry(s: Scope):
    return ifc.create_geometry(s["input"], s.own.get("include"), s.own.get("exclude"), bool(s.own.get("optional")))


@operation("input:ifcfile", catch_all=True, only_local=True)
def filter_attributes(s: Scope):
    return s["input"].filter_attributes(**{k: v for k, v in s.own.items() if k != "input"})


@operation("input:ifcfile", catch_all=True, only_local=True)
def filter_properties(s: Scope):
    return s["input"].filter_properties(**{k: v for k, v in s.own.items() if k != "input"})


@operation("input:surfaceset VOXELSIZE?:real type?:string method?:string")
def voxelize(s: Scope):
    return S.voxelize(s["input"], s["VOXELSIZE"], s["CHUNKSIZE"], s.get("type", "bit"), s.get("method", "surface"), s.get("PADDING", S.PADDING))


for _name, _fn in {
    "fill_gaps": M.fill_gaps, "offset": M.offset, "outmost": R.outmost, "volume": R.volume, "volume2": R.volume2, "exterior": R.exterior,
    "invert": B.invert, "fill_volume": R.fill_volume, "zeros": B.zeros,
}.items():
    operation("input:voxels", _name)(lambda s, f=_fn: f(s["input"]))


@operation("input:voxels")
def count(s: Scope):
    return s["input"].count()


@operation("input:voxels")
def count_components(s: Scope):
    return R.count_components(s["input"])


@operation("input:voxels d:integer|real")
def offset_xy(s: Scope):
    return M.offset_xy(s["input"], s.cells("d"))


@operation("input:voxels type?:string")
def copy(s: Scope):
    return B.copy(s["input"], s.own.get("type"))


for _name, _fn in {"union": B.union, "subtract": B.subtract, "intersect": B.intersect}.items():
    operation("a:voxels b:voxels if_non_empty?:integer", _name)(lambda s, f=_fn: f(s["a"], s["b"], bool(s.get("if_non_empty", 0))))


def _steps(s: Scope) -> tuple[int, int, int]:
    return s.cells("dx"), s.cells("dy"), s.cells("dz")


_STEPS = "input:voxels dx:integer|real dy:integer|real dz:integer|real until?:voxels max?:integer|real"


@operation(_STEPS)
def shift(s: Scope):
    return M.shift(s["input"], *_steps(s))


@operation(_STEPS)
def sweep(s: Scope):
    return M.sweep(s["input"], *_steps(s), s.get("until"), s.cells("max"))


@operation(_STEPS)
def collapse(s: Scope):
    return M.collapse(s["input"], *_steps(s))


@operation(_STEPS)
def collapse_count(s: Scope):
    return M.collapse_count(s["input"], *_steps(s))


@operation("input:voxels seed:voxels depth?:integer|real connectedness?:integer type?:string")
def traverse(s: Scope):
    return R.traverse(s["input"], s["seed"], None if s.get("depth") is None else float(s.cells("depth")), s.get("connectedness", 6), s.get("type", "bit"))


@operation("input:voxels value:integer type?:string")
def constant_like(s: Scope):
    return B.constant_like(s["input"], s["value"], s.get("type", "bit"))


@operation("input:voxels factor:integer")
def resample(s: Scope):
    return M.resample(s["input"], s["factor"])


@operation("input:voxels rhs:integer|real")
def greater_than(s: Scope):
    return M.greater_than(s["input"], s["rhs"])


@operation("input:voxels rhs:integer|real")
def less_than(s: Scope):
    return M.less_than(s["input"], s["rhs"])


@operation("input:voxels min_size:integer")
def keep_components(s: Scope):
    return R.keep_components(s["input"], s["min_size"])


@operation("input:voxels num_neighbours:integer connectivity:integer")
def keep_neighbours(s: Scope):
    return M.keep_neighbours(s["input"], s["num_neighbours"], s["connectivity"])


@operation("input:voxels connectivity:integer")
def count_neighbours(s: Scope):
    return M.count_neighbours(s["input"], s["connectivity"])


@operation("input:voxels axis:integer location:real repetitions:integer")
def repeat_slice(s: Scope):
    return M.repeat_slice(s["input"], s["axis"], s["location"], s["repetitions"])


_PLANE = "input:voxels a:real|integer b:real|integer c:real|integer d:real|integer"


@operation(_PLANE)
def plane(s: Scope):
    return S.plane(s["input"], *(float(s[n]) for n in "abcd"))


@operation(_PLANE)
def halfspace(s: Scope):
    return S.halfspace(s["input"], *(float(s[n]) for n in "abcd"))


_MOVE = "input:surfaceset dx:integer|real dy:integer|real dz:integer|real VOXELSIZE?:real"


@operation(_MOVE)
def local_sweep(s: Scope):
    return S.local_copies(s["input"], *(s.world(n) for n in ("dx", "dy", "dz")), s["VOXELSIZE"])


@operation(_MOVE)
def local_move(s: Scope):
    return S.local_copies(s["input"], *(s.world(n) for n in ("dx", "dy", "dz")), s["VOXELSIZE"], only_last=True)


@operation("x:integer|real y:integer|real z:integer|real input?:voxels", "set")
def set_(s: Scope):
    point, into = [s[n] for n in "xyz"], s.own.get("input")
    as_cells = all(isinstance(p, int) for p in point)
    if into is None:
        from ..grid import Grid

        size, chunk = s["VOXELSIZE"], s.get("CHUNKSIZE", 16)
        world = [p * size if isinstance(p, int) else p for p in point]
        into = Voxels.empty(s.spark, Grid.spanning(tuple(p - 8 * size for p in world), size, (16, 16, 16), chunk))
        return B.put(*(w + size / 2 if as_cells else w for w in world), into)
    return B.put(*point, into, as_cells)


@operation("input:voxels max_depth:integer")
def normal_estimate(s: Scope):
    return shape.normal_estimate(s["input"], s["max_depth"])


_DIM = ("max_depth", "max_depth_2", "distance_2", "neighbourhood_size", "reposition", "inward_distance_approximate", "inward_distance_skip", "subsampling_factor")


@operation("input:voxels " + " ".join(f"{n}?:{'real' if n == 'distance_2' else 'integer'}" for n in _DIM))
def dimensionality_estimate(s: Scope):
    given = {n: s.get(n) for n in _DIM if s.get(n) is not None}
    return shape.dimensionality_estimate(s["input"], **given | {"reposition": bool(given.get("reposition"))})


@operation("input:voxels angular_tolerance?:real max_curvature?:real connectedness?:integer")
def segment(s: Scope):
    return shape.segment(s["input"], s.get("angular_tolerance", 0.1), s.get("max_curvature", 0.01), s.get("connectedness", 26))


@operation("input:voxels filename:string")
def export_csv(s: Scope):
    sinks.export_csv(s["input"], s["filename"])


@operation("input:voxels filename:string")
def export_point_cloud(s: Scope):
    sinks.export_point_cloud(s["input"], s["filename"])


@operation("input:voxels filename:string use_value?:integer with_components?:integer groups?:voxels with_vertex_normals?:integer")
def mesh(s: Scope):
    groups = s.own.get("groups")
    mode = "groups" if groups is not None else "values" if s.own.get("use_value") else "components" if s.own.get("with_components", 1) else "plain"
    sinks.mesh(s["input"], s["filename"], mode, groups, bool(s.own.get("with_vertex_normals")))


@operation("output_path:string variables?:sequence")
def json_stats(s: Scope):
    names = s.own.get("variables") or sorted(s.around)
    sinks.write_json(sinks.stats({n: s.around[n] for n in names if n in s.around}), s["output_path"])


@operation("output_path:string input:voxels")
def describe_components(s: Scope):
    sinks.write_json(summaries.components_info(s["input"]), s["output_path"])


@operation("output_path:string input:voxels groups:voxels use_bits?:integer conserve_memory?:integer only_counts?:integer")
def describe_group_by(s: Scope):
    only = bool(s.own.get("only_counts"))
    rows = summaries.group_by(s["input"], s["groups"], only, bool(s.own.get("conserve_memory"))).orderBy("id")
    sinks.write_json([r.asDict() for r in rows.toLocalIterator()], s["output_path"])


@operation("input:voxels")
def print_components(s: Scope):
    for i, r in enumerate(R.component_sizes(s["input"]).orderBy("label").toLocalIterator()):
        print(f"Component {i} {r['count']}")


@operation("input:voxels")
def print_values(s: Scope):
    print(" ".join(str(r[0]) for r in summaries.values(s["input"]).toLocalIterator()))


@operation("input:ifcfile input_voxels:voxels input_surfaces:surfaceset output_path:string individual_faces?:integer factor?:integer face_count?:integer")
def export_json(s: Scope):
    found = S.overlap(s["input_surfaces"], s["input_voxels"], s.get("factor", 2), bool(s.get("individual_faces", 1)), s.get("face_count", 3))
    rows = found.join(s["input"].elements.select("product_id", "guid"), "product_id").orderBy("product_id")
    sinks.write_json([{"id": r["product_id"], "guid": r["guid"]} for r in rows.toLocalIterator()], s["output_path"])


@operation("input:ifcfile input_voxels:voxels input_surfaces:surfaceset output_path:string")
def export_ifc(s: Scope):
    """The elements with a matching face, with their properties, as tables."""
    if s["input"].num_files != 1:
        raise ValueError("only a single file is supported")
    found = S.matching(s["input_surfaces"], s["input_voxels"]).df.select("product_id").distinct()
    path = s["output_path"]
    s["input"].elements.join(found, "product_id", "left_semi").write.mode("overwrite").parquet(f"{path}/elements")
    s["input"].properties.join(found, "product_id", "left_semi").write.mode("overwrite").parquet(f"{path}/properties")


@operation("input_voxels:voxels input_surfaces:surfaceset output_path:string")
def dump_surfaces(s: Scope):
    """Matching faces' triangles, a folder for each element."""
    found = S.matching(s["input_surfaces"], s["input_voxels"])
    found.df.write.mode("overwrite").partitionBy("product_id").parquet(s["output_path"])


@operation("input:voxels|integer", "assert")
def assert_(s: Scope):
    v = s["input"]
    if v == 0 if isinstance(v, int) else v.is_empty():
        raise AssertionError("Assertion failed")


@operation("input:voxels")
def free(s: Scope):
    s["input"].df.unpersist()


@operation("input:voxels function:string argument:string")
def component_foreach(s: Scope):
    """Runs a user function for each component (or value), bound to ``argument``."""

    def one(c: Voxels) -> None:
        print(c.count())
        s.call(s["function"], {s["argument"]: c})

    R.component_foreach(s["input"], one)


