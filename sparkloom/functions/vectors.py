"""Vector metrics over arrays, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclid", "euclidean", "dot", "manhattan")


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def _squares(a: Column) -> Column:
    return _fold(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_squares(a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    size = F.sqrt(_squares(a) * _squares(b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """A number that is larger for closer vectors."""
    metric = metric.lower()
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if metric == "cosine":
        return cosine_similarity(a, b)
    if metric == "dot":
        return dot(a, b)
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    if metric == "manhattan":
        return -_fold(F.transform(gaps, F.abs))
    return -F.sqrt(_fold(F.transform(gaps, lambda g: g * g)))
