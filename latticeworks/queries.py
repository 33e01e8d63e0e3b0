"""Every operator as a query over grids made from whole test tables, with the same in SQL where SQL ends in time.

Grids, all padded by one cell: ``a`` and ``b`` (all order lines by part, quantity
and discount or tax; sparse), ``c`` (by supplier, quantity and discount; dense
enough for large components that enclose cells), ``e`` (events). They grow with
their tables. ``au`` and ``bu`` count the lines of a cell.

Without SQL are the queries whose SQL would flood around every component of a
grid or grow regions one after the other; tests hold those against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grid import AXES
from .operators import boolean as B
from .operators import morphology as M
from .operators import regions as R
from .operators import shape, summaries
from .operators import surfaces as S
from .plans.interpreter import Interpreter, run
from .plans.language import parse
from .sources import sinks, tables
from .voxels import Voxels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_A = "l_partkey::BIGINT AS gi, floor(l_quantity)::BIGINT AS gj, round(l_discount * 100)::BIGINT AS gk"
_B = _A.replace("l_discount", "l_tax")
_C = _A.replace("l_partkey", "l_suppkey")
_FIRST, _LAST = "(SELECT lo FROM ext)", "(SELECT hi FROM ext)"
_BOX = f"gi BETWEEN {_FIRST} AND {_LAST} AND gj BETWEEN 0 AND 51 AND gk BETWEEN -1 AND 11"
#: The grids, the whole box and the neighbour steps, as SQL.
WITH = f"""
WITH RECURSIVE ext AS (SELECT least(min(l_partkey), min(l_suppkey)) - 1 AS lo, greatest(max(l_partkey), max(l_suppkey)) + 1 AS hi FROM lineitem),
a AS (SELECT DISTINCT {_A} FROM lineitem WHERE l_partkey IS NOT NULL),
b AS (SELECT DISTINCT {_B} FROM lineitem WHERE l_partkey IS NOT NULL),
c AS (SELECT DISTINCT {_C} FROM lineitem WHERE l_suppkey IS NOT NULL),
au AS (SELECT {_A}, count(*)::BIGINT AS val FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY ALL),
bu AS (SELECT {_B}, count(*)::BIGINT AS val FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY ALL),
ev AS (SELECT DISTINCT user_id AS gi, floor(hour(ts) / 6)::BIGINT AS gj, floor(value / 20)::BIGINT AS gk FROM events),
grid AS (SELECT i AS gi, j AS gj, k AS gk FROM (SELECT unnest(range(lo, hi + 1)) AS i FROM ext), range(0, 52) AS y(j), range(-1, 12) AS z(k)),
n26 AS (SELECT i AS di, j AS dj, k AS dk, sqrt(i * i + j * j + k * k) AS w FROM range(-1, 2) AS x(i), range(-1, 2) AS y(j), range(-1, 2) AS z(k) WHERE i <> 0 OR j <> 0 OR k <> 0),
n6 AS (SELECT * FROM n26 WHERE abs(di) + abs(dj) + abs(dk) = 1)
"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL after the shared tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = WITH + sql
        return f

    return add


def grid_a(spark: SparkSession, sf: str) -> Voxels:
    return tables.lines(spark, sf)


def grid_b(spark: SparkSession, sf: str) -> Voxels:
    return tables.lines(spark, sf, third="l_tax")


def grid_c(spark: SparkSession, sf: str) -> Voxels:
    return tables.lines(spark, sf, "l_suppkey")


def grid_au(spark: SparkSession, sf: str) -> Voxels:
    return tables.lines(spark, sf, value=F.count("*"))


def grid_bu(spark: SparkSession, sf: str) -> Voxels:
    return tables.lines(spark, sf, third="l_tax", value=F.count("*"))


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in values.items()))


@query("SELECT * FROM a UNION SELECT * FROM b")
def union(spark, sf):
    return B.union(grid_a(spark, sf), grid_b(spark, sf)).df


@query("SELECT * FROM a EXCEPT SELECT * FROM b")
def subtract(spark, sf):
    return B.subtract(grid_a(spark, sf), grid_b(spark, sf)).df


@query("SELECT * FROM a INTERSECT SELECT * FROM b")
def intersect(spark, sf):
    return B.intersect(grid_a(spark, sf), grid_b(spark, sf)).df


@query("SELECT gi, gj, gk, coalesce(bu.val, au.val) AS val FROM au FULL JOIN bu USING (gi, gj, gk)")
def union_values(spark, sf):
    return B.union(grid_au(spark, sf), grid_bu(spark, sf)).df


@query("SELECT gi, gj, gk, au.val & bu.val AS val FROM au JOIN bu USING (gi, gj, gk) WHERE au.val & bu.val <> 0")
def intersect_values(spark, sf):
    return B.intersect(grid_au(spark, sf), grid_bu(spark, sf)).df


@query("SELECT * FROM au WHERE (gi, gj, gk) NOT IN (SELECT (gi, gj, gk) FROM b)")
def subtract_values(spark, sf):
    return B.subtract(grid_au(spark, sf), grid_b(spark, sf)).df


@query("SELECT * FROM grid EXCEPT SELECT * FROM a")
def invert(spark, sf):
    return B.invert(grid_a(spark, sf)).df


@query("SELECT * FROM a WHERE false")
def zeros(spark, sf):
    return B.zeros(grid_a(spark, sf)).df


@query("SELECT *, 1::BIGINT AS val FROM grid")
def constant_like(spark, sf):
    return B.constant_like(grid_a(spark, sf), 1, "uint").df


@query("SELECT gi, gj, gk FROM au")
def copy(spark, sf):
    return B.copy(grid_au(spark, sf), "bit").df


@query("SELECT * FROM a UNION SELECT 7, 3, 4")
def set_cell(spark, sf):
    return B.put(7.5, 3.5, 4.5, grid_a(spark, sf)).df


_NEAR = "SELECT DISTINCT gi + di AS gi, gj + dj AS gj, gk + dk AS gk FROM a, n26"


@query(f"SELECT * FROM ({_NEAR}) WHERE {_BOX} EXCEPT SELECT * FROM a")
def offset(spark, sf):
    return M.offset(grid_a(spark, sf)).df


@query("SELECT DISTINCT gi + i AS gi, gj + j AS gj, gk FROM a, ext, range(-2, 3) AS x(i), range(-2, 3) AS y(j) WHERE gi + i BETWEEN lo AND hi AND gj + j BETWEEN 0 AND 51")
def offset_xy(spark, sf):
    return M.offset_xy(grid_a(spark, sf), 2).df


@query("""SELECT * FROM a UNION SELECT x.gi + di, x.gj + dj, x.gk + dk FROM a AS x, n6 JOIN a AS y
ON y.gi = x.gi + 2 * di AND y.gj = x.gj + 2 * dj AND y.gk = x.gk + 2 * dk WHERE di + dj + dk = 1""")
def fill_gaps(spark, sf):
    return M.fill_gaps(grid_a(spark, sf)).df


_COUNTS = "SELECT x.gi, x.gj, x.gk, count(y.gi) AS n FROM a AS x CROSS JOIN {n} LEFT JOIN a AS y ON y.gi = x.gi + di AND y.gj = x.gj + dj AND y.gk = x.gk + dk GROUP BY ALL"


@query(f"SELECT gi, gj, gk FROM ({_COUNTS.format(n='n6')}) WHERE n >= 2")
def keep_neighbours(spark, sf):
    return M.keep_neighbours(grid_a(spark, sf), 2, 6).df


@query(f"SELECT gi, gj, gk, n::BIGINT AS val FROM ({_COUNTS.format(n='n26')}) WHERE n > 0")
def count_neighbours(spark, sf):
    return M.count_neighbours(grid_a(spark, sf), 26).df


@query(f"SELECT gi, gj, gk FROM ({_COUNTS.format(n='n26')}) WHERE n > 0 AND n < 26")
def edge_detect(spark, sf):
    return M.edges(grid_a(spark, sf)).df


@query("SELECT gi, gj, gk FROM au WHERE val > 1")
def greater_than(spark, sf):
    return M.greater_than(grid_au(spark, sf), 1).df


@query("SELECT gi, gj, gk FROM au WHERE val < 2")
def less_than(spark, sf):
    return M.less_than(grid_au(spark, sf), 2).df


@query("SELECT gi + 3 AS gi, gj, gk, val FROM au, ext WHERE gi + 3 <= hi")
def shift(spark, sf):
    return M.shift(grid_au(spark, sf), 3, 0, 0).df


@query("SELECT DISTINCT gi, gj, gk - i AS gk FROM a, range(0, 3) AS x(i) WHERE gk - i >= -1")
def sweep(spark, sf):
    return M.sweep(grid_a(spark, sf), dz=-3).df


@query("""SELECT DISTINCT gi + i AS gi, gj, gk FROM
(SELECT a.gi, a.gj, a.gk, least(any_value(hi), any_value(a.gi) + 4, coalesce(min(b.gi) - 1, any_value(hi))) AS last FROM a CROSS JOIN ext
LEFT JOIN b ON b.gj = a.gj AND b.gk = a.gk AND b.gi > a.gi GROUP BY a.gi, a.gj, a.gk), range(0, 5) AS x(i) WHERE gi + i <= last""")
def sweep_until(spark, sf):
    return M.sweep(grid_a(spark, sf), dx=1, until=grid_b(spark, sf), longest=4).df


@query("""SELECT gi, gj, gk, CASE WHEN bool_or(s) THEN 1 ELSE max(val) END::BIGINT AS val FROM (SELECT gi, gj, gk, val, false AS s FROM au
UNION ALL SELECT gi + i, gj, gk, 1, true FROM au, ext, range(1, 200) AS x(i) WHERE i < 2 * val AND gi + i <= hi) GROUP BY gi, gj, gk""")
def sweep_values(spark, sf):
    return M.sweep(grid_au(spark, sf), dx=2).df


_RUNS = "SELECT gi, gj, min(gk) AS gk, count(*) AS val FROM (SELECT *, gk - row_number() OVER (PARTITION BY gi, gj ORDER BY gk) AS g FROM a) GROUP BY gi, gj, g"


@query(f"SELECT gi, gj, gk FROM ({_RUNS})")
def collapse(spark, sf):
    return M.collapse(grid_a(spark, sf)).df


@query(_RUNS)
def collapse_count(spark, sf):
    return M.collapse_count(grid_a(spark, sf)).df


@query("SELECT 2 * gi + i AS gi, 2 * gj + j AS gj, 2 * gk + k AS gk FROM a, range(0, 2) AS x(i), range(0, 2) AS y(j), range(0, 2) AS z(k)")
def resample_up(spark, sf):
    return M.resample(grid_a(spark, sf), 2).df


@query("SELECT DISTINCT floor(gi / 4)::BIGINT AS gi, floor(gj / 4)::BIGINT AS gj, floor(gk / 4)::BIGINT AS gk FROM a")
def resample_down(spark, sf):
    return M.resample(grid_a(spark, sf), -4).df


@query("SELECT gi, CASE WHEN gj > 5 THEN gj + 2 ELSE gj END AS gj, gk FROM a UNION SELECT gi, gj + i, gk FROM a, range(1, 3) AS x(i) WHERE gj = 5")
def repeat_slice(spark, sf):
    return M.repeat_slice(grid_a(spark, sf), 1, 5.5, 2).df


@query("SELECT count(*) AS n FROM ev")
def count(spark, sf):
    return _one(spark, n=tables.events(spark, sf).count())


@query("""SELECT count(*) AS count, min(gi) AS lo_i, max(gi) AS hi_i, min(gj) AS lo_j, max(gj) AS hi_j, min(gk) AS lo_k, max(gk) AS hi_k FROM ev""")
def bounds(spark, sf):
    e = tables.events(spark, sf).df
    return e.agg(F.count("*").alias("count"), *summaries.box_columns())


_REACH = """, r AS (SELECT gi AS ri, gj AS rj, gk AS rk, gi, gj, gk FROM {s} UNION
SELECT m.* FROM (SELECT ri, rj, rk, gi + di AS gi, gj + dj AS gj, gk + dk AS gk FROM r, {n}) AS m SEMI JOIN {g} AS y ON y.gi = m.gi AND y.gj = m.gj AND y.gk = m.gk)
"""
_LABELS = _REACH.format(s="a", n="n6", g="a") + ", l AS (SELECT gi, gj, gk, min((ri, rj, rk)) AS label FROM r GROUP BY gi, gj, gk)\n"


@query(_LABELS + "SELECT count(DISTINCT label) AS n FROM l")
def count_components(spark, sf):
    return _one(spark, n=R.count_components(grid_a(spark, sf)))


@query(_LABELS + "SELECT count(*) AS count, min(gi) AS lo_i, min(gj) AS lo_j, min(gk) AS lo_k, max(gi) AS hi_i, max(gj) AS hi_j, max(gk) AS hi_k FROM l GROUP BY label")
def describe_components(spark, sf):
    return R.component_sizes(grid_a(spark, sf)).drop("label")


@query(_LABELS + "SELECT gi, gj, gk FROM l WHERE label IN (SELECT label FROM l GROUP BY label HAVING count(*) >= 5)")
def keep_components(spark, sf):
    return R.keep_components(grid_a(spark, sf), 5).df


@query(_LABELS + "SELECT gi, gj, gk FROM l WHERE label = (SELECT min(label) FROM l)")
def outmost(spark, sf):
    return R.outmost(grid_a(spark, sf)).df


#: The flood keeps to the box of the cells with one around; all beyond is outside.
_OPEN = """, box AS (SELECT min(gi) - 1 AS i0, max(gi) + 1 AS i1, min(gj) - 1 AS j0, max(gj) + 1 AS j1, min(gk) - 1 AS k0, max(gk) + 1 AS k1 FROM c),
o AS (SELECT i AS gi, j AS gj, k AS gk FROM (SELECT unnest(range(i0, i1 + 1)) AS i FROM box), (SELECT unnest(range(j0, j1 + 1)) AS j FROM box), (SELECT unnest(range(k0, k1 + 1)) AS k FROM box) EXCEPT SELECT * FROM c),
x AS (SELECT i0 AS gi, j0 AS gj, k0 AS gk FROM box UNION
SELECT m.* FROM (SELECT gi + di AS gi, gj + dj AS gj, gk + dk AS gk FROM x, n6) AS m SEMI JOIN o ON o.gi = m.gi AND o.gj = m.gj AND o.gk = m.gk)
"""


@query(_OPEN + "SELECT gi, gj, gk FROM x UNION ALL SELECT gi, gj, gk FROM grid, box WHERE NOT (gi BETWEEN i0 AND i1 AND gj BETWEEN j0 AND j1 AND gk BETWEEN k0 AND k1)")
def exterior(spark, sf):
    return R.exterior(grid_c(spark, sf)).df


@query(_OPEN + "SELECT gi, gj, gk FROM o EXCEPT SELECT gi, gj, gk FROM x")
def volume2(spark, sf):
    return R.volume2(grid_c(spark, sf)).df


#: Components: what a cell reaches that is likely in the largest one, and those of the rest; then a flood around each within its box.
_VOLUMES = """, r AS (SELECT gi, gj, gk FROM (SELECT * FROM c WHERE gj = 25 ORDER BY gi, gj, gk LIMIT 1) UNION
SELECT m.* FROM (SELECT gi + di AS gi, gj + dj AS gj, gk + dk AS gk FROM r, n6) AS m SEMI JOIN c AS y ON y.gi = m.gi AND y.gj = m.gj AND y.gk = m.gk),
rest AS (SELECT * FROM c EXCEPT SELECT * FROM r),
rr AS (SELECT gi AS ri, gj AS rj, gk AS rk, gi, gj, gk FROM rest UNION
SELECT m.* FROM (SELECT ri, rj, rk, gi + di AS gi, gj + dj AS gj, gk + dk AS gk FROM rr, n6) AS m SEMI JOIN rest AS y ON y.gi = m.gi AND y.gj = m.gj AND y.gk = m.gk),
m AS (SELECT (NULL::BIGINT, NULL::BIGINT, NULL::BIGINT) AS label, gi, gj, gk FROM r UNION ALL SELECT min((ri, rj, rk)), gi, gj, gk FROM rr GROUP BY gi, gj, gk),
named AS (SELECT dense_rank() OVER (ORDER BY label) AS p, gi, gj, gk FROM m),
box AS (SELECT p, min(gi) - 1 AS i0, max(gi) + 1 AS i1, min(gj) - 1 AS j0, max(gj) + 1 AS j1, min(gk) - 1 AS k0, max(gk) + 1 AS k1 FROM named GROUP BY p),
o AS (SELECT p, gi, gj, unnest(range(k0, k1 + 1)) AS gk FROM (SELECT p, gi, unnest(range(j0, j1 + 1)) AS gj, k0, k1 FROM (SELECT p, unnest(range(i0, i1 + 1)) AS gi, j0, j1, k0, k1 FROM box)) EXCEPT SELECT * FROM named),
x AS (SELECT p, i0 AS gi, j0 AS gj, k0 AS gk FROM box UNION
SELECT m.* FROM (SELECT p, gi + di AS gi, gj + dj AS gj, gk + dk AS gk FROM x, n6) AS m SEMI JOIN o ON o.p = m.p AND o.gi = m.gi AND o.gj = m.gj AND o.gk = m.gk),
closed AS (SELECT DISTINCT gi, gj, gk FROM (SELECT * FROM o EXCEPT SELECT * FROM x))
"""


@query(_VOLUMES + "SELECT gi, gj, gk FROM closed")
def volume(spark, sf):
    return R.volume(grid_c(spark, sf)).df


@query(_VOLUMES + "SELECT gi, gj, gk FROM closed UNION SELECT * FROM c")
def fill_volume(spark, sf):
    return R.fill_volume(grid_c(spark, sf)).df


def _seed(v: Voxels) -> Voxels:
    return v.with_df(v.df.where(F.col("gj") == 25).orderBy(*AXES).limit(1))


_SEED = "(SELECT * FROM c WHERE gj = 25 ORDER BY gi, gj, gk LIMIT 1)"


@query(_REACH.format(s=_SEED, n="n6", g="c") + "SELECT gi, gj, gk FROM r")
def traverse(spark, sf):
    c = grid_c(spark, sf)
    return R.traverse(c, _seed(c)).df


@query(_REACH.format(s=_SEED, n="n26", g="c") + "SELECT gi, gj, gk FROM r")
def traverse_corners(spark, sf):
    c = grid_c(spark, sf)
    return R.traverse(c, _seed(c), connectedness=26).df


_DEPTH = """, p AS (SELECT gi, gj, gk, 0.0::DOUBLE AS d FROM {s} UNION
SELECT m.* FROM (SELECT gi + di AS gi, gj + dj AS gj, gk + dk AS gk, round(d + w, 9) AS d FROM p, {n} WHERE round(d + w, 9) <= {m} + 1e-9) AS m SEMI JOIN c AS y ON y.gi = m.gi AND y.gj = m.gj AND y.gk = m.gk)
"""


@query(_DEPTH.format(s=_SEED, n="n6", m=4) + "SELECT DISTINCT gi, gj, gk FROM p")
def traverse_depth(spark, sf):
    c = grid_c(spark, sf)
    return R.traverse(c, _seed(c), depth=4).df


@query(_DEPTH.format(s=_SEED, n="n26", m=4) + "SELECT gi, gj, gk, floor(10 * min(d) + 1)::BIGINT AS val FROM p GROUP BY gi, gj, gk")
def traverse_distance(spark, sf):
    c = grid_c(spark, sf)
    return R.traverse(c, _seed(c), depth=4, connectedness=26, kind="uint").df


@query("SELECT bu.val AS id, count(*) AS count, min(gi) AS lo_i, min(gj) AS lo_j, min(gk) AS lo_k, max(gi) AS hi_i, max(gj) AS hi_j, max(gk) AS hi_k FROM c JOIN bu USING (gi, gj, gk) GROUP BY ALL")
def describe_group_by(spark, sf):
    return summaries.group_by(grid_c(spark, sf), grid_bu(spark, sf))


@query("SELECT coalesce(bu.val, 0) AS id, count(*) AS count FROM c LEFT JOIN bu USING (gi, gj, gk) GROUP BY ALL")
def describe_group_by_counts(spark, sf):
    return summaries.group_by(grid_c(spark, sf), grid_bu(spark, sf), only_counts=True, keep_zero=True)


@query("SELECT DISTINCT val FROM au")
def print_values(spark, sf):
    return summaries.values(grid_au(spark, sf))


@query("SELECT gi::DOUBLE AS x, gj::DOUBLE AS y, gk::DOUBLE AS z, val FROM au")
def export_csv(spark, sf):
    return sinks.csv_rows(grid_au(spark, sf))


@query("""SELECT gi, gj, gk, CASE WHEN di <> 0 THEN 0 WHEN dj <> 0 THEN 1 ELSE 2 END AS axis, (di + dj + dk)::INTEGER AS side, 'all' AS name
FROM a, n6 WHERE (gi + di, gj + dj, gk + dk) NOT IN (SELECT (gi, gj, gk) FROM a)""")
def mesh_faces(spark, sf):
    return sinks.faces(grid_a(spark, sf), "plain")


@query("""SELECT x.gi, x.gj, x.gk, CASE WHEN di <> 0 THEN 0 WHEN dj <> 0 THEN 1 ELSE 2 END AS axis, (di + dj + dk)::INTEGER AS side,
least(x.val, coalesce(y.val, 0)) || '-' || greatest(x.val, coalesce(y.val, 0)) AS name
FROM au AS x CROSS JOIN n6 LEFT JOIN au AS y ON y.gi = x.gi + di AND y.gj = x.gj + dj AND y.gk = x.gk + dk
WHERE x.val <> coalesce(y.val, 0) AND (y.val IS NULL OR di + dj + dk = 1)""")
def mesh_values(spark, sf):
    return sinks.faces(grid_au(spark, sf), "values")


def _boxes(spark: SparkSession, sf: str) -> S.Surfaces:
    """A box for each nation: place and size follow from its keys."""
    n = tables.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("p"), F.col("n_regionkey").cast("long").alias("r"))
    lo = [F.col("p") * 3 + 0.25, F.col("r") * 4 + 0.25, F.lit(0.25)]
    hi = [F.col("p") * 3 + 2 + F.col("r") * 0.5 + 0.25, F.col("r") * 4 + 5.25, F.lit(4.25)]
    faces = []
    for f, quad in enumerate(S.BOX_FACES):
        p = [F.struct(*((hi if c >> a & 1 else lo)[a].cast("double").alias("xyz"[a]) for a in range(3))) for c in quad]
        for t, (b, c) in enumerate(((1, 2), (2, 3))):
            faces.append(F.struct(F.lit(f).alias("face_id"), F.lit(t).alias("tri_id"), p[0].alias("v0"), p[b].alias("v1"), p[c].alias("v2")))
    return S.Surfaces(n.select(F.col("p").alias("product_id"), F.explode(F.array(*faces)).alias("f")).select("product_id", "f.*"))


#: A box's surface lies in its first and last cell of an axis; its volume is all cells between.
_SOLID = """, n AS (SELECT n_nationkey AS p, n_regionkey AS r FROM nation),
s AS (SELECT p, p * 3 AS i0, floor(p * 3 + 2 + r * 0.5 + 0.25)::BIGINT AS i1, r * 4 AS j0, r * 4 + 5 AS j1, 0 AS k0, 4 AS k1 FROM n),
v AS (SELECT p, i AS gi, j AS gj, k AS gk, i = i0 OR i = i1 OR j = j0 OR j = j1 OR k = k0 OR k = k1 AS shell
FROM s, range(0, 200) AS x(i), range(0, 60) AS y(j), range(0, 5) AS z(k) WHERE i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1)
"""


@query(_SOLID + "SELECT DISTINCT gi::BIGINT AS gi, gj::BIGINT AS gj, gk::BIGINT AS gk FROM v WHERE shell")
def voxelize(spark, sf):
    return S.voxelize(_boxes(spark, sf), 1.0, 8, padding=2).df


@query(_SOLID + "SELECT DISTINCT gi::BIGINT AS gi, gj::BIGINT AS gj, gk::BIGINT AS gk FROM v")
def voxelize_volume(spark, sf):
    return S.voxelize(_boxes(spark, sf), 1.0, 8, method="volume", padding=2).df


@query(_SOLID + "SELECT gi::BIGINT AS gi, gj::BIGINT AS gj, gk::BIGINT AS gk, max(p)::BIGINT AS val FROM v GROUP BY ALL HAVING max(p) <> 0")
def voxelize_ids(spark, sf):
    return S.voxelize(_boxes(spark, sf), 1.0, 8, kind="uint", padding=2).df


@query(_SOLID + "SELECT DISTINCT p::BIGINT AS product_id FROM v WHERE shell GROUP BY p HAVING count(*) <= 2 * count(*) FILTER (gi <= 30)")
def overlap(spark, sf):
    boxes = _boxes(spark, sf)
    grid = S.grid_for(boxes, 1.0, 8, 2)
    near = Voxels(grid.cells(spark).where("gi <= 30"), grid)
    return S.overlap(boxes, near, individual_faces=False)


#: Cells that the set cells' box touches: one more on every side, within the grid.
_TOUCHED = """, cb AS (SELECT min(gi) - 1 AS i0, max(gi) + 1 AS i1, min(gj) - 1 AS j0, max(gj) + 1 AS j1, min(gk) - 1 AS k0, max(gk) + 1 AS k1 FROM c)
SELECT gi, gj, gk FROM grid, cb WHERE gi BETWEEN i0 AND i1 AND gj BETWEEN j0 AND j1 AND gk BETWEEN k0 AND k1 AND """


@query(_TOUCHED + "gk = 4")
def plane(spark, sf):
    c = grid_c(spark, sf)
    return S.voxelize(S.plane(c, 0.0, 0.0, 1.0, -4.5), 1.0, 1, padding=1, grid=c.grid).df


@query(_TOUCHED + "gj <= 25")
def halfspace(spark, sf):
    c = grid_c(spark, sf)
    return S.voxelize(S.halfspace(c, 0.0, 1.0, 0.0, -25.5), 1.0, 1, method="volume", grid=c.grid).df


def _moved(places: str) -> str:
    """Shells of the boxes moved up by each of some heights."""
    return f"""{_SOLID.replace("0 AS k0, 4 AS k1 FROM n)", f"floor(0.25 + h)::BIGINT AS k0, floor(4.25 + h)::BIGINT AS k1 FROM n, (SELECT unnest({places}) AS h))").replace("range(0, 5) AS z(k)", "range(0, 9) AS z(k)").replace("AND j BETWEEN j0 AND j1)", "AND j BETWEEN j0 AND j1 AND k BETWEEN k0 AND k1)")}
SELECT DISTINCT gi::BIGINT AS gi, gj::BIGINT AS gj, gk::BIGINT AS gk FROM v WHERE shell"""


@query(_moved("[0, 1.125, 2.25]"))
def local_sweep(spark, sf):
    return S.voxelize(S.local_copies(_boxes(spark, sf), 0.0, 0.0, 1.5, 1.0), 1.0, 8, padding=2).df


@query(_moved("[1]"))
def local_move(spark, sf):
    return S.voxelize(S.local_copies(_boxes(spark, sf), 0.0, 0.0, 1.0, 1.0, only_last=True), 1.0, 8, padding=2).df


#: Scatter of the cells within a depth of 2 of each cell, its eigenvalues (l1 to l3, ascending) in closed form, in 1/32766 of their norm.
_SPREAD = """, p AS (SELECT gi AS ri, gj AS rj, gk AS rk, gi, gj, gk, 0.0::DOUBLE AS d FROM c UNION
SELECT m.* FROM (SELECT ri, rj, rk, gi + di AS gi, gj + dj AS gj, gk + dk AS gk, round(d + w, 9) AS d FROM p, n26 WHERE round(d + w, 9) <= 2 + 1e-9) AS m SEMI JOIN c AS y ON y.gi = m.gi AND y.gj = m.gj AND y.gk = m.gk),
nb AS (SELECT DISTINCT ri, rj, rk, (gi - ri)::DOUBLE AS x, (gj - rj)::DOUBLE AS y, (gk - rk)::DOUBLE AS z FROM p),
m1 AS (SELECT ri AS gi, rj AS gj, rk AS gk, sum(x * x) - sum(x) * sum(x) / count(*) AS xx, sum(y * y) - sum(y) * sum(y) / count(*) AS yy, sum(z * z) - sum(z) * sum(z) / count(*) AS zz,
  sum(x * y) - sum(x) * sum(y) / count(*) AS xy, sum(x * z) - sum(x) * sum(z) / count(*) AS xz, sum(y * z) - sum(y) * sum(z) / count(*) AS yz FROM nb GROUP BY ALL),
m2 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM m1),
m3 AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM m2),
m4 AS (SELECT *, CASE WHEN p < 1e-12 THEN 0 ELSE acos(greatest(-1.0, least(1.0, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / pow(p, 3) / 2))) / 3 END AS f FROM m3),
m5 AS (SELECT *, greatest(q + 2 * p * cos(f), 0) AS l3, greatest(q + 2 * p * cos(f + 2 * pi() / 3), 0) AS l1 FROM m4),
m6 AS (SELECT *, greatest(3 * q - l1 - l3, 0) AS l2, xx + yy + zz AS trace FROM m5),
m7 AS (SELECT *, sqrt(l1 * l1 + l2 * l2 + l3 * l3) AS norm FROM m6),
ev3 AS (SELECT *, CASE WHEN norm > 1e-12 THEN trunc(l1 / norm * 32766) ELSE 0 END AS q1, CASE WHEN norm > 1e-12 THEN trunc(l2 / norm * 32766) ELSE 0 END AS q2, CASE WHEN norm > 1e-12 THEN trunc(l3 / norm * 32766) ELSE 0 END AS q3,
  CASE WHEN trace > 1e-12 THEN trunc(l1 / trace * 32766) ELSE 0 END AS qc FROM m7)
"""
#: Where the least eigenvalue is apart from the next, the normal is a cross product of two rows of the shifted scatter: of the three, the longest.
_NORMAL = """, rows AS (SELECT *, xx - l1 AS a, yy - l1 AS b, zz - l1 AS c_ FROM ev3 WHERE q2 - q1 > 33),
cross3 AS (SELECT gi, gj, gk, unnest([
  {'x': xy * yz - xz * b, 'y': xz * xy - a * yz, 'z': a * b - xy * xy},
  {'x': xy * c_ - xz * yz, 'y': xz * xz - a * c_, 'z': a * yz - xy * xz},
  {'x': b * c_ - yz * yz, 'y': yz * xz - xy * c_, 'z': xy * yz - b * xz}]) AS v FROM rows),
longest AS (SELECT gi, gj, gk, max_by(v, v.x * v.x + v.y * v.y + v.z * v.z) AS v FROM cross3 GROUP BY ALL),
unit AS (SELECT gi, gj, gk, abs(v.x) / n AS x, abs(v.y) / n AS y, abs(v.z) / n AS z FROM (SELECT *, sqrt(v.x * v.x + v.y * v.y + v.z * v.z) AS n FROM longest))
SELECT gi, gj, gk, round(qc / 32766, 3) AS curvature, round(trunc(x * 32766) / 32766, 2) AS x, round(trunc(y * 32766) / 32766, 2) AS y, round(trunc(z * 32766) / 32766, 2) AS z FROM ev3 LEFT JOIN unit USING (gi, gj, gk)
"""


@query(_SPREAD + _NORMAL)
def normal_estimate(spark, sf):
    """Curvature, and the normal up to its sign, where the neighbourhood has one (its two least spreads differ)."""
    c = grid_c(spark, sf)
    spread = shape.dimensionality_estimate(c, max_depth=2).df.select(*AXES, (F.col("ny") - F.col("nx") > 33).alias("_one"))
    n = B.spread(shape.normal_estimate(c, 2).df, 1, c).join(B.spread(spread, 1, c), list(AXES))
    parts = [F.when(F.col("_one"), F.round(F.abs(F.col(f"n{x}").cast("double")) / 32766, 2)).alias(x) for x in "xyz"]
    return n.select(*AXES, F.round(F.col("curv") / 32766, 3).alias("curvature"), *parts)


@query(_SPREAD + "SELECT gi, gj, gk, round(q1 / 32766, 3) AS least, round(q2 / 32766, 3) AS middle, round(q3 / 32766, 3) AS most FROM ev3")
def dimensionality_estimate(spark, sf):
    d = shape.dimensionality_estimate(grid_c(spark, sf), max_depth=2).df
    return d.select(*AXES, *(F.round(F.col(c) / 32766, 3).alias(n) for c, n in (("nx", "least"), ("ny", "middle"), ("nz", "most"))))


@query()
def segment(spark, sf):
    return shape.segment(shape.normal_estimate(grid_c(spark, sf), 1)).df


SCRIPT = """gaps = fill_gaps(lines)
around = offset(gaps)
outer = outmost(around)
"""


@query(f""", f AS (SELECT * FROM c UNION SELECT x.gi + di, x.gj + dj, x.gk + dk FROM c AS x, n6 JOIN c AS y
ON y.gi = x.gi + 2 * di AND y.gj = x.gj + 2 * dj AND y.gk = x.gk + 2 * dk WHERE di + dj + dk = 1),
o AS (SELECT * FROM (SELECT DISTINCT gi + di AS gi, gj + dj AS gj, gk + dk AS gk FROM f, n26) WHERE {_BOX} EXCEPT SELECT * FROM f)
{_REACH.format(s='(SELECT * FROM o ORDER BY gi, gj, gk LIMIT 1)', n='n6', g='o')}
SELECT gi, gj, gk FROM r""")
def script(spark, sf):
    """The flagship: a script that fills gaps, goes around the cells and keeps the outmost part."""
    return Interpreter(spark, {"lines": grid_c(spark, sf)}).run(parse(SCRIPT)).df


@query("SELECT gi, gj, gk FROM a EXCEPT SELECT gi, gj, gk FROM b")
def run_operation(spark, sf):
    return run(spark, "subtract", grid_a(spark, sf), grid_b(spark, sf)).df


@query(_LABELS + "SELECT sum(n)::BIGINT AS cells, count(*) AS parts, max(most) AS most FROM (SELECT count(*) AS n, max(gi) AS most FROM l GROUP BY label HAVING count(*) >= 6)")
def component_foreach(spark, sf):
    """A function called with each of the larger components."""
    found = []
    parts = R.component_foreach(R.keep_components(grid_a(spark, sf), 6), lambda c: found.append((c.count(), c.bounds()[1][0])))
    return _one(spark, cells=sum(n for n, _ in found), parts=parts, most=max((i for _, i in found), default=None))


@query("SELECT count(*) AS lines, (SELECT count(*) FROM c) AS solid FROM a")
def json_stats(spark, sf):
    s = sinks.stats({"lines": grid_a(spark, sf), "solid": grid_c(spark, sf)})
    return _one(spark, lines=s["lines"]["count"], solid=s["solid"]["count"])


@query("SELECT count(*) AS hits FROM a WHERE gj = 3 AND gk = 4")
def ray(spark, sf):
    return _one(spark, hits=S.ray_hits(grid_a(spark, sf), (-0.5, 3.5, 4.5), (1.0, 0.0, 0.0)))


@query("SELECT * FROM ev")
def events_grid(spark, sf):
    return tables.events(spark, sf).df


@query("""SELECT gi + di AS gi, gj + dj AS gj, gk + dk AS gk FROM ev, n26 WHERE gi + di BETWEEN 0 AND 1000000 AND gj + dj BETWEEN 0 AND 3 AND gk + dk BETWEEN -1000 AND 1000
EXCEPT SELECT * FROM ev""")
def events_offset(spark, sf):
    return M.offset(tables.events(spark, sf)).df


@query(_REACH.format(s="(SELECT * FROM ev)", n="n6", g="ev") + ", l AS (SELECT gi, gj, gk, min((ri, rj, rk)) AS label FROM r GROUP BY gi, gj, gk) SELECT count(*) AS n FROM (SELECT label FROM l GROUP BY label)")
def events_components(spark, sf):
    return _one(spark, n=R.count_components(tables.events(spark, sf)))
