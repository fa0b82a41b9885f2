"""Number helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 4) -> Column:
    """Half to even on the scaled double; Spark's ``round`` and ``bround`` work on decimals and differ."""
    return F.rint(x * float(10**digits)) / float(10**digits)


def unit(vector: Column) -> Column:
    """The vector in doubles, divided by its length; a zero vector stays."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(wide, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, done.cast("double") / total * 100.0)


def megabytes(size: Column) -> Column:
    return size.cast("double") / 1048576.0
