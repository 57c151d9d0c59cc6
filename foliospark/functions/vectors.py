"""Arithmetic of arrays of numbers, and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """A zero vector's norm counts as 1."""
    one = lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n)
    return dot(a, b) / (one(norm(a)) * one(norm(b)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def similarity(distance: Column, metric: str = "COSINE") -> Column:
    """A hit's score: the cosine itself; any other metric's distance d, inner products too, as 1 / (1 + d)."""
    return distance if metric.upper() == "COSINE" else 1 / (1 + distance)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _hits(found: Column, relevant: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(found, 1, k), relevant))


def precision_at(found: Column, relevant: Column, k: int) -> Column:
    """By k, even if fewer were found."""
    return _hits(found, relevant, k) / F.lit(k)


def recall_at(found: Column, relevant: Column, k: int) -> Column:
    n = F.size(F.array_distinct(relevant))
    return F.when(n > 0, _hits(found, relevant, k) / n).otherwise(F.lit(0.0))


def f1_at(found: Column, relevant: Column, k: int) -> Column:
    p, r = precision_at(found, relevant, k), recall_at(found, relevant, k)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def rounded_share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """Per cent with two decimals; ``empty`` where there is nothing to divide by."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(F.lit(empty))
