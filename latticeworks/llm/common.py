"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table of a data folder, by Spark's reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine is a local one
    made and put into the session; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="latticeworks-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage: a lost executor costs a re-read, not the whole history.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._latticeworks_path = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete what :func:`cut` wrote, once all that was made of it is written itself; other DataFrames are left."""
    for df in cuts:
        path = getattr(df, "_latticeworks_path", None)
        if path is not None:
            drop_path(df.sparkSession, path)


#: A column that holds a whole input row while an operator adds columns of its own.
ROW = "_latticeworks_row"


def packed(docs: DataFrame, **named: str) -> DataFrame:
    """Rows as one struct, beside the named columns: nothing that is added clashes with a column of the input."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(ROW), *(F.col(f"`{c}`").alias(n) for n, c in named.items()))


def unpacked(rows: DataFrame, names: list[str], **changed: str) -> DataFrame:
    """The rows that :func:`packed` took, some columns changed to others beside them."""
    new = {name: F.col(c) for name, c in changed.items()}
    return rows.select(*(new.get(n, F.col(f"{ROW}.`{n}`")).alias(n) for n in names))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`fresh_path`, through Hadoop's file API."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def arrow_fs(path: str):
    """Arrow file system and path within it, for workers; plain paths are local."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path else "file://" + path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which follows the data's size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_small(big: DataFrame, small: DataFrame, on: str | list[str], how: str, bound: int) -> DataFrame:
    """Join with ``small`` broadcast only if it has at most ``bound`` rows.

    ``small`` should be cheap to count (a table that was cut). Beyond the bound
    the join shuffles, and adaptive execution splits skewed partitions.
    """
    if small.limit(bound + 1).count() <= bound:
        small = F.broadcast(small)
    return big.join(small, on, how)


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file: a path as it is, or a public_tokenizers name."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def tidied(run: Callable[[Iterator], Iterator], *caches: dict) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; then caches are emptied and free memory goes back to the system.

    Python workers outlive tasks, and what they keep adds up to the executor's memory."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for c in caches:
                c.clear()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not every C library has it
                pass

    return wrapped
