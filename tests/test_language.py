"""Scripts: syntax, binding, functions, sinks, models."""

from __future__ import annotations

import json

import pytest

from latticeworks import Grid, Voxels
from latticeworks.functions import polygons
from latticeworks.plans.interpreter import Interpreter, run, run_script
from latticeworks.plans.language import Name, SyntaxProblem, parse
from latticeworks.plans.registry import REGISTRY
from latticeworks.sources import ifc, sinks

GRID = Grid.spanning((0.0, 0.0, 0.0), 1.0, (10, 10, 10), 10)


def test_statements_and_functions():
    s = parse('a = f(1, 2.5, x="y", z={"p", "q"})\n\ng(a)\nfunction h(p, q)\n  r = f(p, q)\nreturn r\n')
    assert [str(x) for x in s.statements] == ['a = f(1, 2.5, x="y", z={"p", "q"})', "g(a)"]
    assert s.functions["h"].params == ("p", "q") and s.functions["h"].result == "r"
    assert isinstance(s.statements[1].args[0].value, Name)
    assert parse("f()\n").statements[0].args == ()


@pytest.mark.parametrize("text", ["a = \n", "f(1,\n", "f(1) g(2)\n", "= f(1)\n", 'f("x)\n'])
def test_what_is_no_script(text):
    with pytest.raises(SyntaxProblem, match="offset"):
        parse(text)


def test_all_operations_are_there():
    assert len(REGISTRY) == 56


def vox(spark, cells):
    return Voxels.cells(spark, cells, GRID)


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("nothing(v)", "No operation named nothing"),
        ("shift(v, dx=1, 2, 3)", "Keyword argument supplied after positional argument"),
        ("shift(v, dx=1, dx=2)", "supplied multiple times"),
        ("count(v, v)", "Too many positional arguments"),
        ("union(v)", "No value supplied for b"),
        ("count(v, other=1)", "Keyword argument other unused"),
        ("count(1)", "Expected value of type voxels, got integer"),
        ("count(w)", "Not defined: w"),
    ],
)
def test_errors(spark, text, message):
    with pytest.raises((KeyError, TypeError, NameError), match=message):
        run_script(spark, text + "\n", v=vox(spark, [(1, 1, 1)]))


def test_a_script_with_functions(spark):
    text = "function twice(x)\n  y = offset(x)\n  z = union(x, y)\nreturn z\nb = twice(v)\nassert(b)\nn = count(b)\n"
    assert run_script(spark, text, v=vox(spark, [(5, 5, 5)])) == 27


def test_lengths_follow_the_cell_size(spark):
    assert run_script(spark, "b = sweep(v, dx=0, dy=0, dz=0.15)\nn = count(b)\n", v=vox(spark, [(1, 1, 1)]), VOXELSIZE=0.05) in (3, 4)


def test_assert_fails_on_empty(spark):
    with pytest.raises(AssertionError):
        run_script(spark, "z = zeros(v)\nassert(z)\n", v=vox(spark, [(1, 1, 1)]))
    with pytest.raises(AssertionError):
        run_script(spark, "assert(0)\n")


def test_free_removes_the_variable(spark):
    it = Interpreter(spark, {"v": vox(spark, [(1, 1, 1)])})
    it.run(parse("free(v)\n"))
    assert "v" not in it.variables


def test_component_foreach_runs_the_function(spark, capsys):
    text = 'function f(x)\n  n = count(x)\nreturn n\ncomponent_foreach(v, "f", "x")\n'
    run_script(spark, text, v=vox(spark, [(1, 1, 1), (1, 1, 2), (5, 5, 5)]))
    assert capsys.readouterr().out.split() == ["2", "1"]


def test_calls_with_values(spark):
    assert run(spark, "count", run(spark, "offset", vox(spark, [(5, 5, 5)]))) == 26


def test_sinks(spark, tmp_path):
    v = vox(spark, [(1, 1, 1), (1, 1, 2), (5, 5, 5)])
    sinks.export_csv(v, str(tmp_path / "c"))
    assert sum(p.read_text().count("\n") for p in (tmp_path / "c").glob("part-*")) == 3
    sinks.mesh(v, str(tmp_path / "m.obj"), normals=True)
    lines = (tmp_path / "m.obj").read_text().split("\n")
    assert sum(x.startswith("f ") for x in lines) == 2 * (10 + 6) and [x for x in lines if x.startswith("g ")] == ["g component0", "g component1"]
    assert sum(x.startswith("v ") for x in lines) == 12 + 8
    sinks.save(v, str(tmp_path / "s"))
    assert sinks.load(spark, str(tmp_path / "s")).collect() == v.collect()
    run_script(spark, f'json_stats("{tmp_path}/j.json", variables={{"v", "VOXELSIZE", "none"}})\n', v=v)
    assert json.loads((tmp_path / "j.json").read_text()) == {"v": {"count": 3}, "VOXELSIZE": 0.05}
    run_script(spark, f'describe_components("{tmp_path}/d.json", v)\n', v=v)
    assert [x["count"] for x in json.loads((tmp_path / "d.json").read_text())] == [2, 1]


def test_outward_triangles(spark):
    corners = sinks.triangles(sinks.faces(vox(spark, [(2, 3, 4)]), "plain"), 1.0).collect()
    by: dict = {}
    for c in corners:
        by.setdefault((c["axis"], c["side"], c["tri"]), {})[c["corner"]] = (c["c0"], c["c1"], c["c2"])
    for (axis, side, _), p in by.items():
        a, b, c = (p[i] for i in range(3))
        u, w = [y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, c, strict=True)]
        n = (u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0])
        assert n[axis] == side and sum(map(abs, n)) == 1


POLYGONS = [[(2, 2), (20, 4), (12, 18)], [(0, 0), (10, 0), (10, 10), (0, 10)], [(1, 1), (15, 1), (15, 9), (8, 4), (1, 9)]]


@pytest.mark.parametrize("p", POLYGONS)
def test_polygon_interior_is_filled(p):
    cells = set(polygons.fill(p))
    for x in range(25):
        for y in range(25):
            if polygons.inside((x, y), p):
                assert (x, y) in cells


def test_segments():
    assert polygons.crossing((0, 0), (4, 4), (0, 4), (4, 0))
    assert not polygons.crossing((0, 0), (4, 4), (4, 4), (8, 0))
    assert not polygons.crossing((0, 0), (4, 0), (1, 0), (3, 0))
    assert not polygons.crossing((0, 0), (1, 0), (2, 0), (3, 0))


MODEL = """ISO-10303-21;
HEADER;
FILE_SCHEMA(('IFC2X3'));
ENDSEC;
DATA;
#1=IFCCARTESIANPOINT((0.,0.,0.));
#2=IFCAXIS2PLACEMENT3D(#1,$,$);
#3=IFCLOCALPLACEMENT($,#2);
#4=IFCCARTESIANPOINT((1.,0.));
#5=IFCAXIS2PLACEMENT2D(#4,$);
#6=IFCRECTANGLEPROFILEDEF(.AREA.,$,#5,2.,1.);
#7=IFCDIRECTION((0.,0.,1.));
#8=IFCEXTRUDEDAREASOLID(#6,#2,#7,3.);
#9=IFCSHAPEREPRESENTATION($,'Body','SweptSolid',(#8));
#10=IFCPRODUCTDEFINITIONSHAPE($,$,(#9));
#11=IFCWALL('0123456789abcdefghijkl',$,'a; wall''s name',$,$,#3,#10,$);
#12=IFCDOOR('0123456789abcdefghijkm',$,'door',$,$,#3,#10,$,2.1,0.9);
#13=IFCSIUNIT(*,.LENGTHUNIT.,$,.METRE.);
#14=IFCPROPERTYSINGLEVALUE('IsExternal',$,IFCBOOLEAN(.T.),$);
#15=IFCPROPERTYSET('0123456789abcdefghijkn',$,'p',$,(#14));
#16=IFCRELDEFINESBYPROPERTIES('0123456789abcdefghijko',$,$,$,(#12),#15);
ENDSEC;
END-ISO-10303-21;
"""


def test_model_files(spark, tmp_path):
    (tmp_path / "m.ifc").write_text(MODEL)
    f = ifc.parse(spark, str(tmp_path))
    assert [r["ifc_type"] for r in f.elements.orderBy("product_id").collect()] == ["IfcWall", "IfcDoor"]
    assert f.elements.first()["name"] == "a; wall's name"
    walls = ifc.create_geometry(f, include=["IfcWall"])
    lo, hi = walls.box()
    assert [round(x, 9) for x in (*lo, *hi)] == [0, -0.5, 0, 2, 0.5, 3]
    assert f.filter_attributes(OverallHeight=">2").elements.count() == 1 and f.filter_attributes(OverallHeight="<2").elements.count() == 0
    assert f.filter_properties(IsExternal=1).elements.count() == 1 and f.filter_properties(IsExternal=0).elements.count() == 0
    with pytest.raises(ValueError):
        ifc.create_geometry(f, include=["IfcWall"], exclude=["IfcDoor"])
    with pytest.raises(FileNotFoundError):
        ifc.parse(spark, str(tmp_path / "none*"))
    n = run_script(spark, f'f = parse("{tmp_path}")\ns = create_geometry(f, exclude={{"IfcDoor"}})\nv = voxelize(s)\nn = count(v)\n', VOXELSIZE=0.5, CHUNKSIZE=16, PADDING=4)
    assert n > 0
