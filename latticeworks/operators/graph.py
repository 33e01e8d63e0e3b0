"""Connected components of a table of edges between longs, by star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..settings import settle, written

#: Edges (16 bytes each) that the driver contracts by itself; more are contracted in rounds of tasks.
ALONE = 200_000


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each node's own number, or that of a lesser node that is its own) after joining nodes a and b."""
    label = label.copy()
    while len(a):
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
    return label


def large_star(e: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(e: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them; every edge has a > b."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def labels(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes with an edge (columns a, b); the label is the component's least node.

    The rounds are logarithmic in the number of nodes, whatever the components' diameter.
    """
    if isinstance(edges.schema["a"].dataType, LongType):
        edges = written(edges)
        few = edges.limit(ALONE + 1).toArrow()
        if len(few) <= ALONE:
            a, b = (few[n].to_numpy() for n in ("a", "b"))
            node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            own = merged(np.arange(len(node)), at[: len(a)], at[len(a) :])
            return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(node, pa.int64()), "label": pa.array(node[own], pa.int64())}))
    now = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        now = settle(small_star(large_star(now)))
        s = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if tuple(s) == mark:
            break
        mark = tuple(s)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
