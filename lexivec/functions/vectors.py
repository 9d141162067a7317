"""Vectors as columns: dot product, length, normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Length one; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(doubles(v))


def similarity(a: Column, b: Column) -> Column:
    """Cosine of vectors of length one, kept within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))
