"""Exact top-k inner products by block-at-a-time pruning.

A vector's components are the terms, ``floor(SCALE * x)`` their integer
impacts. Vectors are put in an order that brings like ones together (nearest
of a few centres, fitted on a bounded sample), and ranges of that order are
blocks. A block keeps each term's greatest and least impact and, as forward
index, its vectors. For a query, the sum over the terms of the larger of
impact times greatest and impact times least bounds every score in the block.
Blocks are taken in the order of their bounds and scored through their forward
index until the next bound is below the query's kth score.

Blocks lie in shelves, and a shelf's own greatest and least impacts bound its
scores likewise. Queries travel to shelves, in two waves: first each to the
shelf of the highest bound (of each ``CHUNK`` shelves), which gives it a kth
score; then, with that as threshold, to every other shelf whose bound reaches
it. A task holds one shelf and takes its queries packet by packet, so an index
of any size is moved once in each wave, however many queries there are.

The order only serves pruning: every row is indexed, and results are exact.

Defined cases: a vector that is null or holds a null or non-finite component
takes no part, nor does a null id; vectors of different lengths have no score
together, and empty ones have the score 0; a query never meets rows of its own
id; rows that repeat an id are each a candidate, and repeated query rows of one
id and vector are one query; ties go to the smaller id; with fewer than k
candidates all are returned; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, join_small, partitions

K, SCALE, EVERY = 10, 1024, 100
#: Rows of a block, blocks of a shelf, queries of a packet, shelves whose bounds are looked through at once.
BLOCK, SHELF, GROUP, CHUNK = 128, 64, 256, 4096
#: Chunks of bounds (of CHUNK shelves, 16 bytes a term each) that may be broadcast.
BROADCAST_CHUNKS = 8
#: Rows that the centres are fitted on, and the number of centres.
FIT_ROWS, CENTRES = 4096, 64
NONE = -(2**62)
#: Impacts below this, in vectors of at most 2**20 components, keep sums exact in 64-bit floats.
EXACT = 2**16


def impacts(vector: Column) -> Column:
    """Integer impacts as array<long>; null where the vector takes no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    return F.when(F.coalesce(fine, F.lit(False)), whole)


def centres(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """A few rounds of k-means on the sample, from evenly spaced rows."""
    if len(sample) == 0:
        return np.zeros((1, sample.shape[1] if sample.ndim == 2 else 1))
    c = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)].astype(np.float64)
    for _ in range(rounds):
        near = (2 * sample @ c.T - (c * c).sum(1)).argmax(1)
        for j in np.unique(near):
            c[j] = sample[near == j].mean(0)
    return c


def _dot(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer products: in floats where they hold them, else in integers."""
    if q.size and m.size and max(np.abs(q).max(), np.abs(m).max()) >= EXACT:
        return q.astype(np.int64) @ m.astype(np.int64).T
    return (q.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)


def _nearest(middle: dict[int, np.ndarray]):
    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.int32)
        for i, x in enumerate(v):
            c = middle.get(len(x))
            if c is not None and c.shape[1] == len(x) and len(x):
                out[i] = (2 * c @ np.asarray(x, np.float64) - (c * c).sum(1)).argmax()
        return pd.Series(out)

    return nearest


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows (dim, ...) in lists of up to ``most`` of one dimension, in order."""
    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (r[0] != held[0][0] or len(held) == most):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _narrow(m: np.ndarray) -> np.ndarray:
    """Impacts in 32 bits where they fit."""
    return m.astype(np.int32) if not m.size or np.abs(m).max() < 2**31 else m


def _matrix(raw: bytes, rows: int, dim: int) -> np.ndarray:
    kind = np.int32 if len(raw) == 4 * rows * dim else np.int64
    return np.frombuffer(raw, kind).astype(np.int64).reshape(rows, dim)


SHELVES = "dim int, shelf long, rows int, ids binary, v binary, most binary, least binary, top binary, bottom binary"


def index(vectors: DataFrame, middle: dict[int, np.ndarray], block: int = BLOCK, shelf: int = SHELF) -> DataFrame:
    """Shelves of blocks: ids and impacts, greatest and least impacts of each block and of the shelf."""
    spark = vectors.sparkSession

    def shelves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, own in enumerate(_gathered(batches, block * shelf)):
            dim, _, _, part = own[0]
            m = np.array([r[2] for r in own], np.int64).reshape(len(own), dim)
            first = np.arange(0, len(m), block)
            most, least = np.maximum.reduceat(m, first), np.minimum.reduceat(m, first)
            row = [dim, (part << 32) + n, len(m), np.array([r[1] for r in own], np.int64).tobytes(), _narrow(m).tobytes(), most.tobytes(), least.tobytes(), most.max(0).tobytes(), least.min(0).tobytes()]
            types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["dim", "shelf", "rows", "ids", "v", "most", "least", "top", "bottom"])

    placed = vectors.withColumn("centre", _nearest(middle)("v")).repartitionByRange(partitions(spark), "dim", "centre", "id").sortWithinPartitions("dim", "centre", "id")
    return placed.select("dim", "id", "v", F.spark_partition_id().alias("part")).mapInArrow(shelves, SHELVES)


def best_of_shelf(q: np.ndarray, qid: np.ndarray, start: np.ndarray, m: np.ndarray, ids: np.ndarray, most: np.ndarray, least: np.ndarray, k: int, block: int = BLOCK) -> list[tuple[int, int, int]]:
    """(query, id, score) of each query's best k rows of a shelf, none below its start."""
    bound = _dot(np.maximum(q, 0), most) + _dot(np.minimum(q, 0), least)  # queries x blocks
    order = np.argsort(-bound, axis=1, kind="stable")
    found: list[list[tuple[int, int]]] = [[] for _ in qid]
    floor_ = start.copy()
    for turn in range(len(most)):
        # queries whose next block can still hold a row; grouped by block, so that one product serves them
        b = order[:, turn]
        live = np.flatnonzero(bound[np.arange(len(q)), b] >= floor_)
        if not len(live):
            break
        for j in np.unique(b[live]):
            who = live[b[live] == j]
            lo, hi = j * block, min((j + 1) * block, len(m))
            score = _dot(q[who], m[lo:hi])
            for r, i in enumerate(who):
                s = score[r]
                ok = np.flatnonzero((s >= floor_[i]) & (ids[lo:hi] != qid[i]))
                if len(ok):
                    found[i] = sorted(found[i] + [(-int(s[x]), int(ids[lo + x])) for x in ok])[:k]
                    if len(found[i]) == k:
                        floor_[i] = max(floor_[i], -found[i][-1][0])
    return [(i, vid, -s) for i, rows in enumerate(found) for s, vid in rows]


PACKETS = "dim int, n int, q binary, qv binary, start binary"


def packets(asked: DataFrame, middle: dict[int, np.ndarray], group: int) -> DataFrame:
    """Queries (dim, qid, v, start), like ones together, in packets."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _gathered(batches, group):
            m = np.array([r[2] for r in own], np.int64).reshape(len(own), own[0][0])
            yield _packet(own[0][0], np.array([r[1] for r in own], np.int64), m, np.array([r[3] for r in own], np.int64))

    spark = asked.sparkSession
    placed = asked.withColumn("centre", _nearest(middle)("v")).repartitionByRange(partitions(spark), "dim", "centre", "qid").sortWithinPartitions("dim", "centre", "qid")
    return placed.select("dim", "qid", "v", "start").mapInArrow(packed, PACKETS)


def _packet(dim: int, qid: np.ndarray, q: np.ndarray, start: np.ndarray, shelf: int | None = None) -> pa.RecordBatch:
    columns = [pa.array([dim], pa.int32()), pa.array([len(qid)], pa.int32()), pa.array([qid.tobytes()]), pa.array([_narrow(q).tobytes()]), pa.array([start.tobytes()])]
    names = ["dim", "n", "q", "qv", "start"]
    if shelf is not None:
        columns, names = [pa.array([shelf], pa.int64()), *columns], ["shelf", *names]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _routed(is_first: bool):
    """Packets beside a chunk of shelves' bounds to packets for shelves: the best of the chunk first, later the others that can matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dim, n = r["dim"], r["n"]
                qid, q, start = np.frombuffer(r["q"], np.int64), _matrix(r["qv"], n, dim), np.frombuffer(r["start"], np.int64)
                own = sorted(r["shelves"], key=lambda x: x["shelf"])
                top, bottom = (np.frombuffer(b"".join([x[c] for x in own]), np.int64).reshape(len(own), dim) for c in ("top", "bottom"))
                bound = _dot(np.maximum(q, 0), top) + _dot(np.minimum(q, 0), bottom)
                best = bound.argmax(axis=1)
                for j, x in enumerate(own):
                    who = np.flatnonzero(best == j if is_first else (best != j) & (bound[:, j] >= start))
                    if len(who):
                        yield _packet(dim, qid[who], q[who], start[who], x["shelf"])

    return run


def _scored(k: int, block: int):
    """Shelves, each before the packets for it, to (query_id, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                dim = r["dim"]
                if r["kind"] == 0:
                    blocks = -(-r["rows"] // block)
                    now = {"shelf": r["shelf"], "ids": np.frombuffer(r["ids"], np.int64), "m": _matrix(r["v"], r["rows"], dim), "most": _matrix(r["most"], blocks, dim), "least": _matrix(r["least"], blocks, dim)}
                    continue
                assert now["shelf"] == r["shelf"]
                qid, q, start = np.frombuffer(r["q"], np.int64), _matrix(r["qv"], r["n"], dim), np.frombuffer(r["start"], np.int64)
                rows = best_of_shelf(q, qid, start, now["m"], now["ids"], now["most"], now["least"], k, block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(qid[i]) for i, _, _ in rows], pa.int64()), pa.array([v for _, v, _ in rows], pa.int64()), pa.array([s for _, _, s in rows], pa.int64())], names=["query_id", "vec_id", "score"]
                )

    return run


def search(table: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, shelf: int = SHELF, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows for every row whose id ``every`` divides."""
    spark = table.sparkSession
    vectors = table.select(F.col(id_col).cast("long").alias("id"), impacts(F.col(vector_col)).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").withColumn("dim", F.size("v"))
    vectors = cut(vectors, "vectors")
    # a bounded sample, the same in every run: the least hashes of ids
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).collect()
    middle = {dim: centres(np.array([r["v"] for r in sample if r["dim"] == dim], np.float64), CENTRES) for dim in {r["dim"] for r in sample} - {0}}
    shelves = cut(index(vectors, middle, block, shelf), "shelves")
    chunks = max(1, -(-shelves.count() // chunk))
    bounds = shelves.select("dim", F.pmod(F.xxhash64("shelf"), F.lit(chunks)).alias("chunk"), F.struct("shelf", "top", "bottom").alias("s"))
    bounds = cut(bounds.groupBy("dim", "chunk").agg(F.collect_list("s").alias("shelves")), "bounds")  # about ``chunk`` in a list
    asked = vectors.where(F.col("id") % every == 0).select("dim", F.col("id").alias("qid"), "v").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    names = [f.split()[0] for f in SHELVES.split(", ") if f.split()[0] not in ("top", "bottom")]

    def wave(queries: DataFrame, is_first: bool) -> DataFrame:
        sent = packets(queries, middle, group).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
        sent = join_small(sent, bounds, ["dim", "chunk"], "inner", BROADCAST_CHUNKS).drop("chunk").mapInArrow(_routed(is_first), f"shelf long, {PACKETS}")
        sent = cut(sent, "routed")
        held = shelves.select(*names).join(sent.select("shelf").distinct(), "shelf", "left_semi").withColumn("kind", F.lit(0))
        both = held.unionByName(sent.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        both = both.repartition(partitions(spark), "shelf").sortWithinPartitions("shelf", "kind")
        rows = both.mapInArrow(_scored(k, block), "query_id long, vec_id long, score long")
        best = cut(rows.withColumn("rank", rank).where(F.col("rank") <= k), "best")
        discard(sent)
        return best

    first = wave(asked.withColumn("start", F.lit(NONE).cast("long")), True)
    reached = first.where(F.col("rank") == k).select(F.col("query_id").alias("qid"), F.col("score").alias("kth"))
    asked = asked.join(reached, "qid", "left").select("dim", "qid", "v", F.coalesce("kth", F.lit(NONE)).cast("long").alias("start"))
    every_ = first.unionByName(wave(asked, False)).drop("rank")
    discard(vectors, shelves, bounds)
    return every_.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
