"""Session settings shared by iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="latticeworks-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: cuts the lineage of a loop, survives lost executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: cuts the lineage as :func:`settle` does, in a fraction of its bytes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of at most 40 bytes that a broadcast may have.
BROADCAST_ROWS = 1_000_000


def join_small(big: DataFrame, small: DataFrame, on: str | list[str], how: str, tasks: int | None = None) -> DataFrame:
    """Join with ``small`` (cheap to count) broadcast if it is within the bound; beyond it the join shuffles, over ``tasks`` if given."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    if tasks:
        keys = [on] if isinstance(on, str) else on
        big, small = big.repartition(tasks, *keys), small.repartition(tasks, *keys)
    return big.join(small, on, how)


def ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` with each row's place from 0 in the order of ``by``, without bringing all rows into one task.

    Rows are dealt by ranges; a place is that within the range after the sizes of those before."""
    held = settle(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n")).orderBy("_part").collect()  # one row for each partition
    before, at = [], 0
    for r in sizes:
        before.append((r["_part"], at))
        at += r["_n"]
    if not before:
        return held.drop("_part").withColumn(name, F.lit(0).cast("long"))
    starts = df.sparkSession.createDataFrame(before, "_part int, _at long")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return held.withColumn("_i", nth).join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") + F.col("_i") - 1).drop("_part", "_i", "_at")
