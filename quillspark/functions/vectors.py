"""Similarities of vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(x: Column, y: Column) -> Column:
    """Inner product."""
    return _sum(F.zip_with(x, y, lambda a, b: a * b))


def cosine(x: Column, y: Column) -> Column:
    """Cosine; null for a zero vector."""
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def euclidean(x: Column, y: Column) -> Column:
    """Distance."""
    return F.sqrt(_sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def manhattan(x: Column, y: Column) -> Column:
    """Sum of absolute differences."""
    return _sum(F.zip_with(x, y, lambda a, b: F.abs(a - b)))
