"""Counts, extents and totals that decide whether a listing holds together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(rows: DataFrame, key: Column, out: str) -> DataFrame:
    return rows.groupBy(key.alias(out)).agg(F.count(F.lit(1)).alias("n"))


def dependency_violations(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys that do not determine the values: the least and the greatest differ."""
    v = F.struct(*values)
    return rows.groupBy(*keys).agg(F.min(v).alias("_a"), F.max(v).alias("_z")).where(~F.col("_a").eqNullSafe(F.col("_z"))).drop("_a", "_z")


def extent(rows: DataFrame, keys: list[str], offset: Column, size: Column) -> DataFrame:
    """How far the members of a chunk reach."""
    return rows.groupBy(*keys).agg(F.max(offset + size).alias("extent"))


def totals_hold(parts: DataFrame, wholes: DataFrame, keys: list[str], size: str, declared: str) -> DataFrame:
    """For each scope, whether its parts add up to what it declares."""
    sums = parts.groupBy(*keys).agg(F.sum(size).alias("total"))
    return wholes.join(sums, keys, "left").withColumn("holds", F.coalesce("total", F.lit(0)) == F.col(declared))


def single_best(rows: DataFrame, keys: list[str], score: str, value: str) -> DataFrame:
    """The value of the greatest score, null where several values have it."""
    each = rows.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.min(value).alias("_a"), F.max(value).alias("_z"))
    best = each.groupBy(*keys).agg(F.max_by(F.struct("_a", "_z"), score).alias("_b"))
    return best.select(*keys, F.when(F.col("_b._a") == F.col("_b._z"), F.col("_b._a")).alias(value))
