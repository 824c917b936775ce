"""Similarity and probability expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """0 where both sets are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.when(union != 0, union))


def softmax(*logits: Column) -> list[Column]:
    top = F.greatest(*logits)
    exps = [F.exp(x - top) for x in logits]
    total = sum(exps[1:], exps[0])
    return [e / total for e in exps]


def entropy2(*p: Column) -> Column:
    """Entropy in bits; 1e-10 keeps the logarithm finite."""
    return sum((-x * F.log2(x + 1e-10) for x in p[1:]), -p[0] * F.log2(p[0] + 1e-10))


def _xlog2(x: Column, y: Column) -> Column:
    return F.when(x <= 0, 0.0).otherwise(x * F.log2(F.when((x > 0) & (y > 0), x / y).otherwise(1.0)))


def bernoulli_js_similarity(p: Column, q: Column) -> Column:
    """1 - Jensen-Shannon divergence in bits of two Bernoulli distributions."""
    m = (p + q) / 2
    kl = lambda a: _xlog2(a, m) + _xlog2(1 - a, 1 - m)
    return 1 - (kl(p) + kl(q)) / 2


def mean_and_deviation(x: Column) -> list[Column]:
    """Mean and population deviation; NaN where there is nothing."""
    return [F.coalesce(F.avg(x), F.lit(float("nan"))).alias("mean"), F.coalesce(F.stddev_pop(x), F.lit(float("nan"))).alias("std")]
