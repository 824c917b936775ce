"""Vector expressions on ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvane.functions.binding import let


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.when(n != 0, n))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column) -> Column:
    return let(a, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n == 0, 0.0).otherwise(x / F.when(n != 0, n)))))


def mean_vectors(df: DataFrame, by: list[str], vector: str = "embedding", out: str = "centroid") -> DataFrame:
    """The element-wise mean of each group, with its size; partial sums are made before the shuffle."""
    parts = df.select(*by, F.posexplode(doubles(F.col(vector))).alias("pos", "x"))
    means = parts.groupBy(*by, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"])
    return means.groupBy(*by).agg(ordered.alias(out), F.max("n").alias("n"))
