"""Vectors as array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(v: Column) -> Column:
    """The vector of length one, in single precision as stored vectors are; a zero vector stays."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    inv = (1 / size).cast("float")
    return F.when(size == 0, v).otherwise(F.transform(v, lambda x: (x * inv).cast("float")))


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision; null if the lengths differ."""
    sums = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), sums)
