"""The quantile conventions of positioning reports, kept apart by name.

order_statistics() counts equal values in the scan's tasks before anything is shuffled, so a large group costs its
distinct values; it never gathers a group into an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(n: Column, q: float) -> Column:
    """Index from 0, half up: floor((n - 1) q + 0.5), at most n - 1."""
    return F.least(F.floor((n - 1) * F.lit(q) + F.lit(0.5)), n - 1)


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2)


def truncated(n: Column, q: float) -> Column:
    return F.least(F.floor(n * F.lit(q)), n - 1)


def order_statistics(df: DataFrame, keys: list[str], value: str, wanted: dict[str, object]) -> DataFrame:
    """keys and, for each name, the value at index wanted[name](n) of the group's sorted non-null values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_m"))
    part = Window.partitionBy(*keys)
    run = counts.select(*keys, F.col(value).alias("_v"), F.sum("_m").over(part.orderBy(value)).alias("_to"), F.sum("_m").over(part).alias("_n"), "_m")
    at = {name: f(F.col("_n")) for name, f in wanted.items()}
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("_to") > k, F.col("_v"))).alias(name) for name, k in at.items()])


def linear(value: Column | str, q: float) -> Column:
    """Interpolated between neighbours (an exact aggregate)."""
    return F.percentile(value, q)


def averaged_median(value: Column | str) -> Column:
    return F.median(value)


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float, name: str) -> DataFrame:
    """The smallest value whose cumulative weight reaches q of the group's total; values of equal size are one."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    part = Window.partitionBy(*keys)
    run = sums.withColumn("_to", F.sum("_w").over(part.orderBy(value))).withColumn("_all", F.sum("_w").over(part))
    return run.where(F.col("_to") >= F.lit(q) * F.col("_all")).groupBy(*keys).agg(F.min(value).alias(name))


def monotone(levels: Column) -> Column:
    """An array made non-decreasing by carrying its running maximum."""
    return F.aggregate(levels, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(F.greatest(x, F.element_at(acc, -1))))))
