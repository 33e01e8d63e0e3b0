"""Building models in STEP text: elements, attributes, properties and triangles.

Covers placements, extruded areas over rectangles, circles' polygons and polylines,
faceted breps, mapped items and boolean results' first operands. Each file is parsed
whole in one task; files are spread over tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.surfaces import TRIANGLES, Surfaces

TOKEN = re.compile(r"\s*(?:('(?:[^']|'')*')|(#\d+)|([A-Z_][A-Z0-9_]*)|(-?\d+\.?\d*(?:E[+-]?\d+)?)|(\.[A-Z0-9_]+\.)|([$*(),=]))", re.IGNORECASE)
INSTANCE = re.compile(r"#(\d+)\s*=\s*([A-Z0-9_]+)\s*(\(.*)", re.DOTALL | re.IGNORECASE)
ELEMENTS = "file string, product_id bigint, guid string, ifc_type string, name string, predefined_type string, attrs map<string,double>"
PROPERTIES = "product_id bigint, name string, bool_value boolean, string_value string"
#: Excluded where a call names neither types to include nor to exclude.
DEFAULT_EXCLUDE = ("IfcSpace", "IfcOpeningElement", "IfcFurnishingElement")


class Ref(int):
    """A reference to an instance."""


class Typed(tuple):
    """A typed value: (type, value)."""


def _values(text: str) -> list:
    """The argument list of an instance, from its opening parenthesis."""
    stack: list[list] = [[]]
    names: list[str | None] = []
    pending: str | None = None
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            break
        at = m.end()
        s, ref, word, number, enum, mark = m.groups()
        if mark == "(":
            stack.append([])
            names.append(pending)
            pending = None
        elif mark == ")":
            done, name = stack.pop(), names.pop()
            stack[-1].append(Typed((name, done[0] if done else None)) if name else done)
            if len(stack) == 1:
                return stack[0][0]
        elif mark in ("$", "*"):
            stack[-1].append(None)
        elif s is not None:
            stack[-1].append(s[1:-1].replace("''", "'"))
        elif ref:
            stack[-1].append(Ref(int(ref[1:])))
        elif number:
            stack[-1].append(float(number) if re.search(r"[.E]", number, re.IGNORECASE) else int(number))
        elif enum:
            stack[-1].append({".T.": True, ".F.": False}.get(enum.upper(), enum.strip(".").upper()))
        elif word:
            pending = word.upper()
    raise ValueError("unbalanced parentheses")


def instances(text: str) -> dict[int, tuple[str, list]]:
    """Instances of the data section by number."""
    body = re.search(r"DATA;(.*?)ENDSEC;", text, re.DOTALL | re.IGNORECASE)
    out = {}
    for part in _statements(body[1] if body else ""):
        if m := INSTANCE.match(part.strip()):
            out[int(m[1])] = (m[2].upper(), _values(m[3]))
    return out


def _statements(body: str) -> Iterator[str]:
    at = start = 0
    quoted = False
    while at < len(body):
        c = body[at]
        if c == "'":
            quoted = not quoted
        elif c == ";" and not quoted:
            yield body[start:at]
            start = at + 1
        at += 1


#: Types that stand for a supertype in filters (element types of the common schemas).
SUBTYPES = {"IfcWall": ("IfcWallStandardCase", "IfcWallElementedCase"), "IfcSlab": ("IfcSlabStandardCase", "IfcSlabElementedCase"), "IfcBeam": ("IfcBeamStandardCase",), "IfcColumn": ("IfcColumnStandardCase",), "IfcDoor": ("IfcDoorStandardCase",), "IfcWindow": ("IfcWindowStandardCase",), "IfcFurnishingElement": ("IfcFurniture", "IfcSystemFurnitureElement")}


class Model:
    """One file's instances and their geometry."""

    def __init__(self, text: str):
        self.all = instances(text)

    def of(self, ref) -> tuple[str, list]:
        return self.all[int(ref)]

    def unit(self) -> float:
        """Metres of one length unit."""
        scale = {"MILLI": 1e-3, "CENTI": 1e-2, "DECI": 1e-1, "KILO": 1e3, None: 1.0}
        for kind, a in self.all.values():
            if kind == "IFCSIUNIT" and a[1] == "LENGTHUNIT":
                return scale.get(a[2], 1.0)
        return 1.0

    def direction(self, ref, default: tuple) -> np.ndarray:
        v = np.array(self.of(ref)[1][0] if ref is not None else default, float)
        return v / np.linalg.norm(v)

    def placement(self, ref) -> np.ndarray:
        """A 4x4 matrix of an axis placement, in three dimensions."""
        m = np.eye(4)
        if ref is None:
            return m
        kind, a = self.of(ref)
        at = np.zeros(3)
        p = self.of(a[0])[1][0]
        at[: len(p)] = p
        m[:3, 3] = at
        if kind == "IFCAXIS2PLACEMENT2D":
            x = np.append(self.direction(a[1], (1.0, 0.0))[:2], 0)
            z = np.array([0.0, 0.0, 1.0])
        else:
            z = self.direction(a[1], (0.0, 0.0, 1.0))
            x = self.direction(a[2], (1.0, 0.0, 0.0) if abs(z[0]) < 0.999 else (0.0, 1.0, 0.0))
            x = x - z * (x @ z)
            x /= np.linalg.norm(x)
        m[:3, 0], m[:3, 1], m[:3, 2] = x, np.cross(z, x), z
        return m

    def world(self, ref) -> np.ndarray:
        """Matrix of a local placement through all those it is relative to."""
        if ref is None or self.of(ref)[0] != "IFCLOCALPLACEMENT":
            return np.eye(4)
        a = self.of(ref)[1]
        return self.world(a[0]) @ self.placement(a[1])

    def profile(self, ref) -> list[tuple[float, float]]:
        kind, a = self.of(ref)
        if kind == "IFCARBITRARYCLOSEDPROFILEDEF":
            ring = [tuple(self.of(p)[1][0][:2]) for p in self.of(a[2])[1][0]]
            return ring[:-1] if ring[0] == ring[-1] else ring
        if kind == "IFCRECTANGLEPROFILEDEF":
            x, y = a[3] / 2, a[4] / 2
            flat = [(-x, -y), (x, -y), (x, y), (-x, y)]
        elif kind == "IFCCIRCLEPROFILEDEF":
            flat = [(a[3] * math.cos(t), a[3] * math.sin(t)) for t in np.linspace(0, 2 * math.pi, 32, endpoint=False)]
        else:
            return []
        m = self.placement(a[2])
        return [tuple((m @ [x, y, 0, 1])[:2]) for x, y in flat]

    def faces(self, ref) -> Iterator[list[np.ndarray]]:
        """Polygons of a representation item."""
        kind, a = self.of(ref)
        if kind == "IFCEXTRUDEDAREASOLID":
            ring = self.profile(a[0])
            if not ring:
                return
            m = self.placement(a[1])
            up = self.direction(a[2], (0.0, 0.0, 1.0)) * a[3]
            low = [np.array([x, y, 0.0]) for x, y in ring]
            for f in [low[::-1], [p + up for p in low], *([p, q, q + up, p + up] for p, q in zip(low, low[1:] + low[:1], strict=True))]:
                yield [(m @ np.append(p, 1))[:3] for p in f]
        elif kind in ("IFCFACETEDBREP", "IFCFACETEDBREPWITHVOIDS"):
            yield from self.shell(a[0])
        elif kind in ("IFCFACEBASEDSURFACEMODEL", "IFCSHELLBASEDSURFACEMODEL"):
            for s in a[0]:
                yield from self.shell(s)
        elif kind in ("IFCBOOLEANCLIPPINGRESULT", "IFCBOOLEANRESULT"):
            yield from self.faces(a[1])
        elif kind == "IFCMAPPEDITEM":
            source, target = self.of(a[0])[1], self.of(a[1])[1]
            m = np.eye(4)
            m[:3, 3] = self.of(target[2])[1][0]
            m = m @ np.linalg.inv(self.placement(source[0]))
            for item in self.of(source[1])[1][3]:
                for f in self.faces(item):
                    yield [(m @ np.append(p, 1))[:3] for p in f]

    def shell(self, ref) -> Iterator[list[np.ndarray]]:
        for face in self.of(ref)[1][0]:
            for bound in self.of(face)[1][0][:1]:
                loop = self.of(self.of(bound)[1][0])[1][0]
                yield [np.array(self.of(p)[1][0], float) for p in loop]

    def products(self) -> Iterator[tuple[int, str, list]]:
        for i, (kind, a) in sorted(self.all.items()):
            if len(a) >= 7 and isinstance(a[0], str) and len(a[0]) == 22 and isinstance(a[5], Ref) and self.of(a[5])[0] == "IFCLOCALPLACEMENT":
                yield i, kind, a

    def triangles(self) -> Iterator[tuple]:
        unit = self.unit()
        for i, _, a in self.products():
            if a[6] is None or self.of(a[6])[0] != "IFCPRODUCTDEFINITIONSHAPE":
                continue
            m = self.world(a[5])
            n = 0
            for rep in self.of(a[6])[1][2]:
                r = self.of(rep)[1]
                if r[1] not in ("Body", "Facetation", None):
                    continue
                for item in r[3]:
                    for f in self.faces(item):
                        p = [tuple(((m @ np.append(x, 1))[:3] * unit).tolist()) for x in f]
                        for t, (b, c) in enumerate(ears(p)):
                            yield i, n, t, b, *c
                        n += 1

    def properties(self) -> Iterator[tuple]:
        """(product, name, bool, string) of single values in property sets."""
        for kind, a in self.all.values():
            if kind != "IFCRELDEFINESBYPROPERTIES":
                continue
            pset, p = self.of(a[5])
            if pset != "IFCPROPERTYSET":
                continue
            for x in p[4]:
                name, v = self.of(x)
                if name != "IFCPROPERTYSINGLEVALUE" or v[2] is None:
                    continue
                value = v[2][1] if isinstance(v[2], Typed) else v[2]
                for product in a[4]:
                    yield int(product), v[0], value if isinstance(value, bool) else None, value if isinstance(value, str) else None


def ears(p: list[tuple]) -> Iterator[tuple[tuple, tuple]]:
    """Triangles (first, (second, third)) of a simple planar polygon, by cutting ears."""
    pts = np.array(p, float)
    normal = reduce(np.add, (np.cross(a, b) for a, b in zip(pts, np.roll(pts, -1, 0), strict=True)), np.zeros(3))
    ring = list(range(len(p)))
    while len(ring) > 3:
        for n in range(len(ring)):
            i, j, k = ring[n - 1], ring[n], ring[(n + 1) % len(ring)]
            if np.cross(pts[j] - pts[i], pts[k] - pts[j]) @ normal <= 0:
                continue
            if any(all(np.cross(pts[b] - pts[a], pts[o] - pts[a]) @ normal >= 0 for a, b in ((i, j), (j, k), (k, i))) for o in ring if o not in (i, j, k)):
                continue
            yield p[i], (p[j], p[k])
            ring.pop(n)
            break
        else:
            ring.pop(0)
    if len(ring) == 3:
        yield p[ring[0]], (p[ring[1]], p[ring[2]])


#: Attributes that are numbers, by position, of element types that have them.
NUMBERS = {
    "IFCDOOR": {"OverallHeight": 8, "OverallWidth": 9}, "IFCWINDOW": {"OverallHeight": 8, "OverallWidth": 9}, "IFCSTAIRFLIGHT": {"RiserHeight": 10, "TreadLength": 11},
    "IFCSITE": {"RefElevation": 11}, "IFCBUILDING": {"ElevationOfRefHeight": 9, "ElevationOfTerrain": 10}, "IFCBUILDINGSTOREY": {"Elevation": 9},
    "IFCSPACE": {"ElevationWithFlooring": 10}, "IFCREINFORCINGBAR": {"NominalDiameter": 9, "BarLength": 11},
}


def camel(kind: str) -> str:
    """Element type as written in filters; compared without regard to case."""
    return "Ifc" + kind[3:].capitalize()


@dataclass(frozen=True)
class Files:
    """Parsed files: elements, properties and triangles; filters narrow the elements."""

    elements: DataFrame
    properties: DataFrame
    triangles: DataFrame
    num_files: int

    def of_types(self, types: list[str], inside: bool = True) -> Files:
        names = [t.lower() for x in types for t in (x, *SUBTYPES.get(x, ()))]
        at = F.lower("ifc_type").isin(names)
        return replace(self, elements=self.elements.where(at if inside else ~at))

    def filter_attributes(self, **tests: str) -> Files:
        """Elements whose number attributes satisfy all of ``<n``, ``>n``, ``=n``; a name that no type has is an error."""
        found = self.elements
        for name, test in tests.items():
            if not any(name in own for own in NUMBERS.values()):
                raise ValueError(f"Unknown attribute {name}")
            if not re.match(r"[<>=]", test):
                raise ValueError(f"Unsupported filter {test}")
            v, x = F.col("attrs")[name], float(test[1:])
            cond = {"<": v < x, ">": v > x, "=": v == x}[test[0]]
            found = found.where(F.coalesce(cond, F.lit(False)))
        return replace(self, elements=found)

    def filter_properties(self, **tests: int | str) -> Files:
        """Elements with all of the named property values; digits in names are written as n."""
        name = F.translate("name", "0123456789", "n" * 10)
        found = self.elements
        for key_, value in tests.items():
            same = F.col("string_value") == value if isinstance(value, str) else F.col("bool_value") == bool(value)
            own = self.properties.where((name == key_) & F.coalesce(same, F.lit(False))).select("product_id")
            found = found.join(own, "product_id", "left_semi")
        return replace(self, elements=found)


def parse(spark: SparkSession, pattern: str, recursive: bool = True) -> Files:
    """All files of a glob; an error if there is none. Product ids are made unique over files."""
    try:
        files = spark.read.option("recursiveFileLookup", recursive).text(pattern, wholetext=True).select(F.input_file_name().alias("file"), "value")
        n = files.count()
    except Exception as e:
        raise FileNotFoundError(f"No files found for {pattern}") from e
    if not n:
        raise FileNotFoundError(f"No files found for {pattern}")
    names = {r["file"]: i for i, r in enumerate(files.select("file").orderBy("file").collect())}

    def base(file: str) -> int:
        return names[file] << 32

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                m, rows = Model(r.value), []
                unit = m.unit()
                for i, kind, a in m.products():
                    extra = a[8] if len(a) > 8 and kind in ("IFCSLAB", "IFCCOVERING", "IFCROOF") and isinstance(a[8], str) else None
                    numbers = {x: float(a[n]) * unit for x, n in NUMBERS.get(kind, {}).items() if n < len(a) and isinstance(a[n], (int, float))}
                    rows.append((r.file, base(r.file) + i, a[0], camel(kind), a[2], extra, numbers))
                yield pd.DataFrame(rows, columns=["file", "product_id", "guid", "ifc_type", "name", "predefined_type", "attrs"])

    def properties(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                rows = [(base(r.file) + i, n, b, s) for i, n, b, s in Model(r.value).properties()]
                yield pd.DataFrame(rows, columns=["product_id", "name", "bool_value", "string_value"])

    def triangles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def point(p: tuple) -> dict:
            return dict(zip("xyz", map(float, p), strict=True))

        for pdf in batches:
            for r in pdf.itertuples():
                rows = [(base(r.file) + i, f, t, point(a), point(b), point(c)) for i, f, t, a, b, c in Model(r.value).triangles()]
                yield pd.DataFrame(rows, columns=["product_id", "face_id", "tri_id", "v0", "v1", "v2"])

    return Files(files.mapInPandas(elements, ELEMENTS), files.mapInPandas(properties, PROPERTIES), files.mapInPandas(triangles, TRIANGLES), n)


def create_geometry(files: Files, include: list[str] | None = None, exclude: list[str] | None = None, optional: bool = False) -> Surfaces:
    """Triangles of the elements that the type lists let through.

    Roof slabs: an included IfcRoof also lets through slabs whose predefined type is
    ROOF; otherwise listing slabs keeps those that are not (as the described behaviour has it)."""
    if include and exclude:
        raise ValueError("include and exclude cannot both be given")
    roof = F.upper(F.coalesce("predefined_type", F.lit(""))) == "ROOF"
    slab = F.lower("ifc_type").startswith("ifcslab")
    if include:
        types = list(include)
        kept = files.of_types([*types, "IfcSlab"] if "IfcRoof" in types else types)
        if "IfcRoof" in types:
            kept = replace(kept, elements=kept.elements.where(~slab | roof))
    else:
        types = list(exclude) if exclude else list(DEFAULT_EXCLUDE)
        if "IfcSlab" in types and "IfcRoof" not in types:
            kept = files.of_types([t for t in types if t != "IfcSlab"], inside=False)
            kept = replace(kept, elements=kept.elements.where(~slab | ~roof))
        else:
            kept = files.of_types(types, inside=False)
    kept = replace(kept, elements=kept.elements.where(~F.lower(F.coalesce("name", F.lit(""))).contains("nulpunt")))
    out = Surfaces(files.triangles.join(kept.elements.select("product_id", "guid"), "product_id"))
    if not optional and out.is_empty():
        raise RuntimeError("No geometries initialised")
    return out
