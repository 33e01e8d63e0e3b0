"""Grids that grow from streams of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..grid import AXES, Grid


def new_cells(stream: DataFrame, grid: Grid, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each cell of a stream once: duplicates are dropped by state, which a watermark on ``time`` bounds."""
    own = stream.where(grid.inside())
    if time is None:
        return own.select(*AXES).dropDuplicates(list(AXES))
    return own.withWatermark(time, late).dropDuplicatesWithinWatermark(list(AXES)).select(*AXES, time)


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write new cells to a folder of Parquet files until the input is used up."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
