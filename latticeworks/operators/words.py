"""Cells packed along z into 64-bit words, for dilations.

A word row stands for up to 64 cells, so a dilation shuffles a fraction of the
rows, and steps along z are bit operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def pack(cells: DataFrame) -> DataFrame:
    """(gi, gj, gw, bits) from cells."""
    bit = F.expr("shiftleft(1L, cast(pmod(gk, 64) as int))")
    return cells.groupBy("gi", "gj", F.floor(F.col("gk") / WORD).alias("gw")).agg(F.bit_or(bit).alias("bits"))


def unpack(words: DataFrame) -> DataFrame:
    """Cells from words."""
    at = F.expr("filter(sequence(0, 63), b -> (shiftrightunsigned(bits, b) & 1L) = 1L)")
    return words.select("gi", "gj", F.explode(at).alias("b"), "gw").select("gi", "gj", (F.col("gw") * WORD + F.col("b")).alias("gk"))


def _or(words: DataFrame) -> DataFrame:
    return words.groupBy("gi", "gj", "gw").agg(F.bit_or("bits").alias("bits"))


def dilate_z(words: DataFrame) -> DataFrame:
    """Words with each cell's neighbours above and below; words may repeat."""
    own = F.struct(F.col("gw").alias("gw"), F.expr("bits | shiftleft(bits, 1) | shiftrightunsigned(bits, 1)").alias("bits"))
    up = F.struct((F.col("gw") + 1).alias("gw"), F.expr("shiftrightunsigned(bits, 63)").alias("bits"))
    down = F.struct((F.col("gw") - 1).alias("gw"), F.expr("shiftleft(bits & 1L, 63)").alias("bits"))
    spread = words.select("gi", "gj", F.explode(F.array(own, up, down)).alias("w"))
    return spread.select("gi", "gj", "w.gw", "w.bits").where("bits <> 0")


def dilate_xy(words: DataFrame, d: int, axis: str | None = None) -> DataFrame:
    """Words spread over the square of 2d + 1 columns around each; with an axis, along it only."""
    near = F.sequence(F.lit(-d), F.lit(d))
    out = words
    for a in [axis] if axis else ["gi", "gj"]:
        out = out.withColumn("_s", F.explode(near)).withColumn(a, (F.col(a) + F.col("_s")).cast("long")).drop("_s")
    return out


def dilated(cells: DataFrame, d: int = 1, z: bool = True) -> DataFrame:
    """Cells of the dilation by the full neighbourhood (z), or by a square of each layer."""
    words = pack(cells)
    if z:
        return unpack(_or(dilate_xy(dilate_z(words), 1)))
    if d <= 1:
        return unpack(_or(dilate_xy(words, d)))
    # a square is a row of rows; two passes cost 2 (2d + 1) instead of (2d + 1) ** 2
    return unpack(_or(dilate_xy(_or(dilate_xy(words, d, "gi")), d, "gj")))


def bit_count(words: DataFrame) -> Column:
    return F.sum(F.bit_count("bits"))
