"""Column functions on numbers and vectors (structs x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def near(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two numbers differ by less than ``tolerance``, relative to the larger of 1 and both."""
    return F.abs(a - b) < tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def compared(a: Column, b: Column, tolerance: float) -> Column:
    """-1, 0 or 1 as ``a`` is smaller than, near or larger than ``b``."""
    return F.when(near(a, b, tolerance), 0).when(a < b, -1).otherwise(1)


def _vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def minus(a: Column, b: Column) -> Column:
    return _vector(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def cross(a: Column, b: Column) -> Column:
    return _vector(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def mean_variance(values: Column, mask: Column | None = None) -> tuple[Column, Column]:
    """Aggregates: mean and population variance of the values where ``mask`` holds."""
    kept = values if mask is None else F.when(mask, values)
    return F.avg(kept), F.var_pop(kept)


def unique_sorted(array: Column) -> Column:
    return F.array_sort(F.array_distinct(array))


def count_matches(a: Column, b: Column) -> Column:
    """Places at which two arrays of one length are equal."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda hit: hit))
