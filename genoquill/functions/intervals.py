"""Algebra of open-right intervals, as expressions on two bounds and as operators on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _i(lower: Column, upper: Column) -> Column:
    return F.struct(lower.cast("long").alias("lower"), upper.cast("long").alias("upper"))


def empty() -> Column:
    """[0, 0), what stands for no interval."""
    return _i(F.lit(0), F.lit(0))


def intersects(a: Column, b: Column) -> Column:
    return (a["lower"] < b["upper"]) & (b["lower"] < a["upper"])


def adjacent(a: Column, b: Column) -> Column:
    return (a["upper"] == b["lower"]) | (b["upper"] == a["lower"])


def disjoint(a: Column, b: Column) -> Column:
    return ~intersects(a, b)


def intersection(a: Column, b: Column) -> Column:
    return F.when(intersects(a, b), _i(F.greatest(a["lower"], b["lower"]), F.least(a["upper"], b["upper"]))).otherwise(empty())


def merge(a: Column, b: Column) -> Column:
    """The union of intervals that intersect or touch, else the empty interval."""
    return F.when(intersects(a, b) | adjacent(a, b), _i(F.least(a["lower"], b["lower"]), F.greatest(a["upper"], b["upper"]))).otherwise(empty())


def contains_offset(a: Column, x: Column) -> Column:
    return (a["lower"] <= x) & (x < a["upper"])


def contains_interval(a: Column, b: Column) -> Column:
    return (a["lower"] <= b["lower"]) & (b["upper"] <= a["upper"])


def translate(a: Column, by: Column) -> Column:
    return _i(a["lower"] + by, a["upper"] + by)


def translate_zero(a: Column) -> Column:
    return _i(F.lit(0), a["upper"] - a["lower"])


def simplify(df: DataFrame, keys: list[str], lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Per key the disjoint intervals that cover the rows; overlapping and touching ones become one."""
    order = W.partitionBy(*keys).orderBy(lower, upper)
    t = df.select(*keys, lower, upper).withColumn("_reach", F.max(upper).over(order.rowsBetween(W.unboundedPreceding, -1)))
    t = t.withColumn("_island", F.sum(F.when(F.col("_reach").isNull() | (F.col(lower) > F.col("_reach")), 1).otherwise(0)).over(order))
    return t.groupBy(*keys, "_island").agg(F.min(lower).alias(lower), F.max(upper).alias(upper)).drop("_island")


def gaps(df: DataFrame, keys: list[str], lower: str = "lower", upper: str = "upper") -> DataFrame:
    """The intervals between consecutive disjoint intervals of a key that do not touch (introns between exons)."""
    nxt = F.lead(lower).over(W.partitionBy(*keys).orderBy(lower))
    return df.select(*keys, F.col(upper).alias(lower), nxt.alias(upper)).where(F.col(upper) > F.col(lower))
