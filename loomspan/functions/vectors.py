"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm2(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm2(a) * norm2(b))


def euclid(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def rbf(d: Column, sigma: float, tau: float = 1.0) -> Column:
    return F.exp(-d * d / (2 * tau * sigma * sigma))


def finite(v: str) -> Column:
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def normalized(v: str, order: int = 2) -> Column:
    size = norm2(v) if order == 2 else F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x))
    return F.transform(v, lambda x: x / (size + 1e-8))


def long(df: DataFrame, v: str = "v") -> DataFrame:
    """One row for each component: dim, x."""
    return df.select(*(c for c in df.columns if c != v), F.posexplode(v).alias("dim", "x"))


def centroids(df: DataFrame, key: str, v: str = "v") -> DataFrame:
    """(key, c): mean vector of each group, components in order."""
    means = long(df.select(key, v), v).groupBy(key, "dim").agg(F.avg("x").alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("c"))
