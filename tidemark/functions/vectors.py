"""Distances between points held in columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    """Sum of squared differences, unrolled so that it stays in generated code."""
    return reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b, strict=True)])


def squared_array_distance(a: Column, b: Column) -> Column:
    """The same for two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x)
