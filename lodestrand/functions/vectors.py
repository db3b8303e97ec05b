"""Vector measures as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def comparable(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(a) == F.size(b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for null, empty or zero vectors and for other lengths."""
    lengths = norm(a) * norm(b)
    return F.when(comparable(a, b) & (lengths > 0), dot(a, b) / lengths).otherwise(F.lit(0.0))


def inner_product(a: Column, b: Column) -> Column:
    return F.when(comparable(a, b), dot(a, b)).otherwise(F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance; null where lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(comparable(a, b), F.sqrt(_sum(squares)))
