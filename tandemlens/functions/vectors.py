"""Vector arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(col: Column) -> Column:
    return col.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with the usual floor of 1e-12 on each norm."""
    floor = F.lit(1e-12)
    return dot(a, b) / (F.greatest(norm(a), floor) * F.greatest(norm(b), floor))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def ratio(num: Column, den: Column) -> Column:
    """num / den, and 0 where the denominator is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))
