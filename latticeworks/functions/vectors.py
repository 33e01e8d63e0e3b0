"""Element-wise functions of three-component struct columns (x, y, z)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

XYZ = "xyz"


def vec(x, y, z) -> Column:
    return F.struct(*(c if isinstance(c, Column) else F.lit(c) for c in (x, y, z))).cast("struct<x:double,y:double,z:double>")


def _each(a: Column, b: Column, f) -> Column:
    return F.struct(*(f(a[n], b[n]).alias(n) for n in XYZ))


def add(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x - y)


def mul(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x * y)


def div(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x / y)


def mod(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x % y)


def scale(a: Column, s) -> Column:
    return F.struct(*((a[n] * s).alias(n) for n in XYZ))


def least(a: Column, b: Column) -> Column:
    return _each(a, b, F.least)


def greatest(a: Column, b: Column) -> Column:
    return _each(a, b, F.greatest)


def floor(a: Column) -> Column:
    return F.struct(*(F.floor(a[n]).alias(n) for n in XYZ))


def ceil(a: Column) -> Column:
    return F.struct(*(F.ceil(a[n]).alias(n) for n in XYZ))


def floor_div(a: Column, d: int) -> Column:
    return F.struct(*(F.floor(a[n] / d).alias(n) for n in XYZ))


def ceil_div(a: Column, d: int) -> Column:
    return F.struct(*(F.ceil(a[n] / d).alias(n) for n in XYZ))


def absolute(a: Column) -> Column:
    return F.struct(*(F.abs(a[n]).alias(n) for n in XYZ))


def total(a: Column) -> Column:
    return a["x"] + a["y"] + a["z"]


def product(a: Column) -> Column:
    return a["x"] * a["y"] * a["z"]


def dot(a: Column, b: Column) -> Column:
    return total(mul(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def all_of(a: Column, test) -> Column:
    return reduce(lambda p, q: p & q, (test(a[n]) for n in XYZ))


def any_of(a: Column, test) -> Column:
    return reduce(lambda p, q: p | q, (test(a[n]) for n in XYZ))
