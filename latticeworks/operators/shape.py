"""Local shape from principal components of geodesic neighbourhoods, and segments of like normals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, ShortType, StructField, StructType

from ..grid import AXES, Triple, key, steps, unkey
from ..settings import join_small, ranked, settle, written
from ..voxels import NORMAL, U32, Voxels
from . import tiles
from .boolean import KEY, invert, spread
from .morphology import neighbours, offset
from .regions import SLACK, distances, run_cells

SCALE = 32766.0
QUANTISED = StructType([StructField(n, ShortType()) for n in ("nx", "ny", "nz", "curv")])
MOMENTS = ("n", "x", "y", "z", "xx", "yy", "zz", "xy", "xz", "yz")


def reach(cells: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(c, gi, gj, gk, dist): cells within ``depth`` steps' length of each start (c its packed seed)."""
    near = F.array(*(F.struct(*(F.lit(x).cast("long").alias(n) for x, n in zip(s, "ijk", strict=True)), F.lit(sum(x * x for x in s) ** 0.5).alias("w")) for s in steps(26)))
    best = settle(start.withColumn("dist", F.lit(0.0)))
    fresh, again = best, True
    while again:  # depth rounds at most: every step is 1 at least
        moved = fresh.withColumn("_s", F.explode(near))
        moved = moved.select("c", *((F.col(x) + F.col(f"_s.{n}")).alias(x) for x, n in zip(AXES, "ijk", strict=True)), F.round(F.col("dist") + F.col("_s.w"), 9).alias("dist"))
        moved = moved.where(F.col("dist") <= depth + SLACK).groupBy("c", *KEY).agg(F.min("dist").alias("dist")).join(cells, KEY, "left_semi")
        # old and new distances meet in one aggregation; a row is fresh if the new one won
        both = best.withColumn("_old", F.lit(True)).unionByName(moved.withColumn("_old", F.lit(False)))
        best = settle(both.groupBy("c", *KEY).agg(F.min("dist").alias("dist"), F.min(F.when(F.col("_old"), F.col("dist"))).alias("_was")))
        fresh = best.where("_was IS NULL OR dist < _was").select("c", *KEY, "dist")
        again = not fresh.isEmpty()
        best = best.drop("_was")
    return best


def _moments(pairs: DataFrame) -> DataFrame:
    # around the seed, so that large indices cancel without loss
    x, y, z = ((F.col(a) - o).cast("double") for a, o in zip(AXES, unkey(F.col("c")), strict=True))
    return pairs.groupBy("c").agg(
        F.count("*").cast("double").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(z).alias("z"),
        F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(z * z).alias("zz"), F.sum(x * y).alias("xy"), F.sum(x * z).alias("xz"), F.sum(y * z).alias("yz"),
    )


def scatter(m: pd.DataFrame) -> np.ndarray:
    """Scatter matrices around the mean from moments."""
    a = np.empty((len(m), 3, 3))
    mean = m[["x", "y", "z"]].to_numpy() / m[["n"]].to_numpy()
    for i, p in enumerate("xyz"):
        for j, q in enumerate("xyz"):
            a[:, i, j] = m["".join(sorted(p + q))].to_numpy() - mean[:, i] * mean[:, j] * m["n"].to_numpy()
    return a


def _quantised(x: np.ndarray) -> np.ndarray:
    return np.trunc(np.nan_to_num(x) * SCALE).astype(np.int16)


def _normal(m: pd.DataFrame) -> pd.DataFrame:
    values, vectors = np.linalg.eigh(scatter(m))
    total = values.sum(1)
    curv = np.divide(np.maximum(values[:, 0], 0), total, out=np.zeros(len(total)), where=total > 0)
    n = vectors[:, :, 0]
    return pd.DataFrame({"nx": _quantised(n[:, 0]), "ny": _quantised(n[:, 1]), "nz": _quantised(n[:, 2]), "curv": _quantised(curv)})


def _spread(m: pd.DataFrame) -> pd.DataFrame:
    values = np.maximum(np.linalg.eigvalsh(scatter(m)), 0)
    size = np.linalg.norm(values, axis=1)
    e = np.divide(values, size[:, None], out=np.zeros_like(values), where=size[:, None] > 0)
    q = _quantised(e)
    return pd.DataFrame({"nx": q[:, 0], "ny": q[:, 1], "nz": q[:, 2], "curv": np.zeros(len(q), np.int16)})


def _column(fn):
    @F.pandas_udf(QUANTISED)
    def of(*cols: pd.Series) -> pd.DataFrame:
        return fn(pd.DataFrame(dict(zip(MOMENTS, cols, strict=True))))

    return of(*MOMENTS)


#: Depths up to which neighbourhoods are made within tiles, and distances that are held for it at once.
NEAR, HELD = 8, 4_000_000


def offsets(depth: int) -> tuple[list[Triple], list[list[tuple[int, float]]]]:
    """Offsets that ``depth`` may reach, nearest first, and for each those that it may be reached from with the step's length."""

    def least(o: Triple) -> float:
        a, b, c = sorted(map(abs, o))
        return a * 3**0.5 + (b - a) * 2**0.5 + (c - b)

    box = range(-depth, depth + 1)
    found = sorted(((i, j, k) for i in box for j in box for k in box if least((i, j, k)) <= depth + SLACK), key=lambda o: (least(o), o))
    at = {o: n for n, o in enumerate(found)}
    before = []
    for o in found:
        own = [(tuple(x - y for x, y in zip(o, s, strict=True)), sum(x * x for x in s) ** 0.5) for s in steps(26)]
        before.append([(at[q], w) for q, w in own if q in at and least(q) + w <= depth + SLACK])
    return found, before


def _near(a: Voxels, depth: int, fn) -> Voxels:
    """What ``fn`` makes of the moments of each cell's neighbourhood, tile by tile: no pair of cells leaves its task."""
    found, before = offsets(depth)
    o = np.array(found, float)
    weights = np.stack([np.ones(len(o)), *o.T, *(o.T**2), o[:, 0] * o[:, 1], o[:, 0] * o[:, 2], o[:, 1] * o[:, 2]], 1)

    def of(tile: tiles.Tile, at: np.ndarray) -> dict[str, np.ndarray]:
        set_ = tile.dense(at)
        own = at[tile.holds(tile.cells(at))]
        out, many = [], max(1, HELD // len(found))
        for lo in range(0, len(own), many):
            seed = own[lo : lo + many]
            there = [set_[seed + tile.step(s)] for s in found]
            dist = np.full((len(found), len(seed)), np.inf)
            dist[0] = 0
            again = True
            while again:
                again = False
                for n in range(1, len(found)):
                    best = dist[n]
                    for q, w in before[n]:
                        best = np.minimum(best, np.round(dist[q] + w, 9))
                    best = np.where(there[n] & (best <= depth + SLACK), best, np.inf)
                    if not np.array_equal(best, dist[n]):
                        dist[n], again = best, True
            m = np.isfinite(dist).astype(float).T @ weights
            out.append(fn(pd.DataFrame(m, columns=list(MOMENTS))))
        values = pd.concat(out) if out else fn(pd.DataFrame(np.empty((0, len(MOMENTS))), columns=list(MOMENTS)))
        return dict(zip(KEY, tile.cells(own), strict=True)) | {c: values[c].to_numpy() for c in values}

    schema = "gi long, gj long, gk long, nx short, ny short, nz short, curv short"
    return Voxels(tiles.settled(a.df.select(*KEY), depth, schema, of, a.parts), a.grid, NORMAL, a.parts)


def _seeds(cells: DataFrame) -> DataFrame:
    return cells.select(key(*(F.col(a) for a in AXES)).alias("c"), *KEY)


def normal_estimate(a: Voxels, max_depth: int) -> Voxels:
    """Normal and curvature of each cell from the cells within ``max_depth`` of it."""
    if max_depth <= NEAR:
        return _near(a, max_depth, _normal)
    a.grid.packable()
    cells = settle(a.df.select(*KEY))
    m = _moments(reach(cells, _seeds(cells), max_depth))
    return _valued(a, cells, m.select("c", _column(_normal).alias("r")).select("c", "r.*"))


def _valued(a: Voxels, cells: DataFrame, values: DataFrame) -> Voxels:
    return Voxels(_seeds(cells).join(values, "c").select(*KEY, "nx", "ny", "nz", "curv"), a.grid, NORMAL)


def dimensionality_estimate(a: Voxels, max_depth: int | None = None, max_depth_2: int | None = None, distance_2: float | None = None, neighbourhood_size: int | None = None, reposition: bool = False, inward_distance_approximate: int | None = None, inward_distance_skip: int | None = None, subsampling_factor: int | None = None) -> Voxels:
    """Ascending eigenvalues over their norm, of each cell's neighbourhood."""
    if subsampling_factor is not None and subsampling_factor != 2:
        raise ValueError("Only subsampling_factor of 2 currently supported")
    if max_depth is None and neighbourhood_size is None:
        raise ValueError("Either max_depth or neighbourhood_size needs to be provided")
    if inward_distance_approximate and not subsampling_factor:
        raise ValueError("inward_distance_approximate requires subsampling_factor to be set")
    if neighbourhood_size is None and max_depth <= NEAR and not reposition and distance_2 is None and not inward_distance_approximate and not inward_distance_skip:
        return _near(a, max_depth, _spread)
    a.grid.packable()
    cells = settle(a.df.select(*KEY))
    full, given = cells, None
    if inward_distance_approximate or inward_distance_skip:
        # depth within the grid: steps by faces from the cells that border on unset ones
        shell = offset(invert(a))
        depth = distances(a.bits(), shell.df, 6).select(*KEY, F.floor("dist").alias("_d"))
        deep = cells.join(depth, KEY, "left").withColumn("_d", F.coalesce("_d", F.lit(0)))
        skip = F.lit(False) if not inward_distance_skip else F.col("_d") >= inward_distance_skip
        even = (F.pmod(F.col("gi"), F.lit(2)) == 0) & (F.pmod(F.col("gj"), F.lit(2)) == 0) & (F.pmod(F.col("gk"), F.lit(2)) == 0)
        later = F.lit(False) if not inward_distance_approximate else (F.col("_d") >= inward_distance_approximate) & ~even
        deep = settle(deep.withColumn("_later", later).withColumn("_skip", skip & ~later))
        third = int(SCALE / 3**0.5)
        given = deep.where("_skip").select(*KEY, *(F.lit(third).cast("short").alias(n) for n in ("nx", "ny", "nz")), F.lit(0).cast("short").alias("curv"))
        cells = deep.where("NOT _skip AND NOT _later").select(*KEY)
    seeds = _seeds(cells)
    pairs = _neighbourhood(full, seeds, max_depth, neighbourhood_size)
    if reposition:
        mean = pairs.groupBy("c").agg(*(F.avg(x).alias(f"m{x}") for x in AXES))
        off = sum(((F.col(x) - F.col(f"m{x}")) ** 2 for x in AXES[1:]), (F.col("gi") - F.col("mgi")) ** 2)
        moved = pairs.join(mean, "c").groupBy("c").agg(F.min_by(F.struct(*KEY), F.struct(F.round(off, 9), *KEY)).alias("s")).select("c", "s.*")
        pairs = _neighbourhood(full, moved, max_depth if max_depth_2 is None else max_depth_2, neighbourhood_size)
    if distance_2 is not None:
        w = Window.partitionBy("c")
        off = sum(((F.col(x) - F.avg(x).over(w)) ** 2 for x in AXES[1:]), (F.col("gi") - F.avg("gi").over(w)) ** 2)
        pairs = pairs.withColumn("_o", F.sqrt(off))
        centred = pairs.withColumns({f"_m{x}": F.avg(x).over(w) for x in AXES}).where(F.col("_o") < distance_2)
        # the scatter stays around the mean of all: shift the kept cells and restore the sums
        x, y, z = (F.col(n) - F.col(f"_m{n}") for n in AXES)
        m = centred.groupBy("c").agg(F.count("*").cast("double").alias("n"), *(F.lit(0.0).alias(n) for n in "xyz"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(z * z).alias("zz"), F.sum(x * y).alias("xy"), F.sum(x * z).alias("xz"), F.sum(y * z).alias("yz"))
    else:
        m = _moments(pairs)
    out = _valued(a, cells, m.select("c", _column(_spread).alias("r")).select("c", "r.*"))
    if given is None:
        return out
    out = out.with_df(settle(out.df.unionByName(given)))
    if inward_distance_approximate:
        # left-out cells take the mean of their valued neighbours of the halved raster
        open_ = deep.where("_later").select(key(*(F.col(x) for x in AXES)).alias("c"), *KEY)
        near = neighbours(open_.withColumns({f"_p{x}": F.pmod(F.col(x), F.lit(2)) for x in AXES}), [s for s in steps(26)], [F.col("c"), *(F.col(f"_p{x}") for x in AXES), F.col("_s")])
        odd = F.lit(True)
        for x, n in zip(AXES, "ijk", strict=True):
            odd = odd & ((F.col(f"_s.{n}") == 0) | (F.col(f"_p{x}") == 1))
        mean = near.where(odd).join(out.df, KEY).groupBy("c").agg(*(F.avg(n).cast("short").alias(n) for n in ("nx", "ny", "nz")), F.lit(0).cast("short").alias("curv"))
        out = out.with_df(out.df.unionByName(open_.join(mean, "c").select(*KEY, "nx", "ny", "nz", "curv")))
    return out


def _neighbourhood(cells: DataFrame, seeds: DataFrame, depth: int | None, size: int | None) -> DataFrame:
    """Cells around each seed: within a depth, or the ``size`` nearest (ties in index order) within a growing depth."""
    if size is None:
        return reach(cells, seeds, depth)
    guess, before = 1, None
    while True:
        found = reach(cells, seeds, guess if depth is None else min(guess, depth))
        counts = found.groupBy("c").count()
        short = counts.where(F.col("count") < size)
        left, total = short.count(), found.count()
        if not left or total == before or guess == depth:
            break
        guess, before = guess + 1, total
    nth = F.row_number().over(Window.partitionBy("c").orderBy("dist", *KEY))
    return found.withColumn("_n", nth).where(F.col("_n") <= size).drop("_n")


#: Cells of a component that one task segments by itself; smaller ones share tasks of about a quarter of that, larger ones
#: lose a region a round, all of them at once.
ALONE = 200_000


def _close(tolerance: float):
    """Whether normals (of x, y: lists of three arrays) may both be like one seed's: their lines differ by twice the tolerance at most."""
    least = np.cos(2 * tolerance) - SLACK if 2 * tolerance < np.pi / 2 else 0.0

    def fits(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        a, b = (np.sqrt(sum(c * c for c in v)) for v in (x, y))
        # a normal of more than unit length may be like more than its direction is
        return (np.abs(sum(c * d for c, d in zip(x, y, strict=True))) >= least * a * b) | (a > SCALE) | (b > SCALE)

    return fits


def _like(nx: np.ndarray, ny: np.ndarray, nz: np.ndarray, seed: tuple[float, float, float], tolerance: float) -> np.ndarray:
    dot = (nx * (seed[0] / SCALE) + ny * (seed[1] / SCALE) + nz * (seed[2] / SCALE)) / SCALE
    return np.arccos(np.minimum(np.abs(dot), 1.0)) <= tolerance


def regions_of(cells: np.ndarray, normals: np.ndarray, curv: np.ndarray, tolerance: float, connectedness: int) -> np.ndarray:
    """Index of the seed of each cell's region; regions are grown one after the other from the flattest cell left."""
    n = len(cells)
    order = np.lexsort((cells[:, 2], cells[:, 1], cells[:, 0]))
    lo = cells.min(0) - 1
    size = cells.max(0) - lo + 2
    code = ((cells - lo) @ np.array([size[1] * size[2], size[2], 1])).astype(np.int64)
    ranked = code[order]
    near = np.full((n, connectedness), -1, np.int64)
    for c, s in enumerate(steps(connectedness)):
        want = code + int(np.array(s) @ np.array([size[1] * size[2], size[2], 1]))
        at = np.minimum(np.searchsorted(ranked, want), n - 1)
        near[:, c] = np.where(ranked[at] == want, order[at], -1)
    region = np.full(n, -1, np.int64)
    for seed in np.lexsort((cells[:, 2], cells[:, 1], cells[:, 0], curv)):
        if region[seed] >= 0:
            continue
        region[seed] = seed
        front = np.array([seed])
        while len(front):
            q = near[front].ravel()
            q = np.unique(q[q >= 0])
            q = q[region[q] < 0]
            front = q[_like(normals[q, 0], normals[q, 1], normals[q, 2], tuple(normals[seed]), tolerance)]
            region[front] = seed
    return region


def segment(a: Voxels, angular_tolerance: float = 0.1, max_curvature: float = 0.01, connectedness: int = 26, alone: int = ALONE) -> Voxels:
    """Regions of like normals: again and again the flattest cell left and what it reaches through cells that
    are flat enough and whose normals differ by at most the tolerance. Labels count from 1.

    Neighbours in a region are both like its seed, and so like each other within twice the tolerance. So a region lies
    within a component of flat cells of which only such neighbours belong together, and each is segmented by itself;
    the seeds' order over all gives the labels."""
    if a.kind != NORMAL:
        raise ValueError("Expected normal and curvature voxel type")
    if connectedness not in (6, 26):
        raise ValueError("Connectedness should be 6 or 26")
    values = ["nx", "ny", "nz", "curv"]
    seeded = StructType([StructField(n, LongType()) for n in (*KEY, "si", "sj", "sk", "sc")])

    def grown(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, curv = pdf[KEY].to_numpy(np.int64), pdf["curv"].to_numpy(np.int64)
        seed = regions_of(cells, pdf[["nx", "ny", "nz"]].to_numpy(float), curv, angular_tolerance, connectedness)
        return pd.DataFrame(np.concatenate([cells, cells[seed], curv[seed, None]], axis=1), columns=seeded.names)

    a.grid.packable()
    fits = _close(angular_tolerance)
    left = written(a.df.where(F.col("curv") / SCALE <= max_curvature))
    done = a.spark.createDataFrame([], seeded)
    while not left.isEmpty():
        found = tiles.labelled(left, connectedness, a.parts, ("nx", "ny", "nz"), fits)
        size = found.parts().groupBy("label").agg(F.sum("n").alias("_n"))
        named = spread(left, 1, a).join(spread(run_cells(found.runs(), "label"), 1, a), KEY)
        held = written(join_small(named, written(size), "label", "inner", a.parts))
        tasks = -(-held.count() * 4 // ALONE)
        small = held.where(F.col("_n") <= alone).withColumn("_task", F.pmod(F.xxhash64("label"), F.lit(tasks)))
        done = done.unionByName(written(small.repartition(tasks, "_task").groupBy("_task").applyInPandas(grown, seeded)))
        big = held.where(F.col("_n") > alone)
        # of each large component: its seed, the cells like it, and what the seed reaches among those
        seed = big.groupBy("label").agg(F.min_by(F.struct(*KEY, *values), F.struct("curv", *KEY)).alias("_s"))
        big = big.join(seed, "label")
        dot = (F.col("nx") * (F.col("_s.nx") / SCALE) + F.col("ny") * (F.col("_s.ny") / SCALE) + F.col("nz") * (F.col("_s.nz") / SCALE)) / SCALE
        here = (F.col("gi") == F.col("_s.gi")) & (F.col("gj") == F.col("_s.gj")) & (F.col("gk") == F.col("_s.gk"))
        like = written(big.where((F.acos(F.least(F.abs(dot), F.lit(1.0))) <= angular_tolerance) | here).select(*KEY, "nx", "ny", "nz", "_s"))
        if like.isEmpty():
            break
        parts = run_cells(tiles.labelled(like, connectedness, a.parts, ("nx", "ny", "nz"), fits).runs(), "label").join(like, KEY)
        own = parts.where((F.col("gi") == F.col("_s.gi")) & (F.col("gj") == F.col("_s.gj")) & (F.col("gk") == F.col("_s.gk"))).select("label")
        region = written(parts.join(own, "label", "left_semi").select(*KEY, F.col("_s.gi").alias("si"), F.col("_s.gj").alias("sj"), F.col("_s.gk").alias("sk"), F.col("_s.curv").cast("long").alias("sc")))
        done = done.unionByName(region)
        left = written(big.select(*KEY, *values).join(region, KEY, "left_anti"))
    seeds = ranked(done.select("sc", "si", "sj", "sk").distinct(), ["sc", "si", "sj", "sk"], "val")
    return Voxels(done.join(seeds, ["sc", "si", "sj", "sk"]).select(*KEY, (F.col("val") + 1).alias("val")), a.grid, U32)
