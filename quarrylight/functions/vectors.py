"""Column builders over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def shifted_cosine(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2, within [0, 1]; 0 for different lengths and vectors of nearly no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (dot(a, b) / norm + 1) / 2))
    return F.when((F.size(a) == F.size(b)) & (norm > 1e-12), score).otherwise(F.lit(0.0))
