"""Statistics as column arithmetic and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The normal quantile of a 95 % interval.
Z = 1.959964


def wilson(p: Column, n: Column) -> tuple[Column, Column]:
    """Interval of a share p of n; nothing is known from n <= 0."""
    z2 = Z * Z
    centre, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0)
    high = F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(1.0)
    return low, high


def _bits(p: Column, m: Column) -> Column:
    return F.when(p > 0, 0.5 * p * F.log2(p / m)).otherwise(0.0)


def jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two share columns; an aggregate."""
    m = (p + q) / 2
    return F.greatest(F.lit(0.0), F.sum(_bits(p, m) + _bits(q, m)))


def entropy(p: Column) -> Column:
    """Normalised by the number of shares; null for fewer than two."""
    n = F.count(p)
    return F.when(n >= 2, -F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0)) / F.log2(n))


def gini(df: DataFrame, value: str) -> DataFrame:
    """One row, gini. Ranked rather than paired; nulls are dropped and a sum of 0 gives null."""
    v = F.col(value)
    counts = df.where(v.isNotNull()).groupBy(v.cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    upto = Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    n, total = F.sum("_c"), F.sum(F.col("_v") * F.col("_c"))
    # The ranks of _c equal values sum to _c * (2 * _before + _c + 1) / 2.
    weighted = F.sum(F.col("_v") * F.col("_c") * (2 * F.col("_before") + F.col("_c")))
    return ranked.agg(F.when(total != 0, (weighted - n * total) / (n * total)).alias("gini"))


def nearest_rank(values: Column, q: float) -> Column:
    """The value at position round(q (n - 1)), half to even; an aggregate that keeps a group's values."""
    a = F.array_sort(F.collect_list(values))
    return F.get(a, F.bround(q * (F.size(a) - 1), 0).cast("int"))


def representation(share: Column, base: Column) -> tuple[Column, Column]:
    """Ratio and its binary logarithm; null without a baseline, and no logarithm of 0."""
    ratio = F.when(base > 0, share / base)
    return ratio, F.when(ratio > 0, F.log2(ratio))
