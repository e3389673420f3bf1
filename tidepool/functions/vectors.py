"""Vector functions. Arithmetic is in doubles, whatever the stored type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors, different lengths and zero norms."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (size == 0) | size.isNull(), 0.0).otherwise(dot(a, b) / size)
