"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.greatest(dot(a, a), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / F.nullif(n, F.lit(0.0))))


def idf(n: Column, df: Column) -> Column:
    """Robertson's weight, never negative."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def forgetting(hours: Column, decay: float) -> Column:
    return F.exp(F.lit(-decay) * F.greatest(hours, F.lit(0.0)))
