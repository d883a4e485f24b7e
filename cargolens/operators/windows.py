"""Order-dependent checks and fills over the rows of a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def monotonic(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """For each scope, whether value strictly grows along order."""
    before = F.lag(value).over(_w(keys, order))
    return rows.select(*keys, F.coalesce(F.col(value) > before, F.lit(True)).alias("_up")).groupBy(*keys).agg(F.bool_and("_up").alias("monotonic"))


def contiguous(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """For each scope, whether its numbers are 1 to n."""
    rank = F.row_number().over(_w(keys, [number]))
    return rows.select(*keys, (rank == F.col(number)).alias("_is")).groupBy(*keys).agg(F.bool_and("_is").alias("contiguous"))


def tiling(ranges: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """For each scope: gaps and overlaps between neighbours, and the ends of the whole."""
    before = F.lag(end).over(_w(keys, [start, end]))
    marked = ranges.select(*keys, start, end, (F.col(start) > before).alias("_gap"), (F.col(start) < before).alias("_over"))
    return marked.groupBy(*keys).agg(
        F.count_if("_gap").cast("long").alias("gaps"), F.count_if("_over").cast("long").alias("overlaps"), F.min(start).alias("first_start"), F.max(end).alias("last_end")
    )


def forward_fill(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The last non-null value so far."""
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))


def prefix_offset(rows: DataFrame, keys: list[str], order: list[str], size: Column, out: str) -> DataFrame:
    """The sum of the sizes before."""
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0).cast("bigint")))


def running_cap(rows: DataFrame, keys: list[str], order: list[str], size: Column, cap: int, out: str) -> DataFrame:
    """Rows whose running sum is within the cap."""
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum(size).over(w)).where(F.col(out) <= cap)


def consecutive_distinct(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Rows that differ from the one before."""
    now, before = F.struct(*values), F.lag(F.struct(*values)).over(_w(keys, order))
    return rows.withColumn("_before", before).where(~F.col("_before").eqNullSafe(now)).drop("_before")


def longest_run(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """For each scope the length of the longest run of equal values."""
    within = F.row_number().over(_w(keys, order)) - F.row_number().over(_w([*keys, value], order))
    runs = rows.select(*keys, value, within.alias("_island")).groupBy(*keys, value, "_island").agg(F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(*keys).agg(F.max("_n").alias("longest_run"))


def gap_to_next(rows: DataFrame, keys: list[str], start: str, end: str, limit: str) -> DataFrame:
    """gap: from a segment's end to the nearest start at or after it, else to limit. One sweep over starts and ends, no self-join."""
    points = rows.select(*keys, F.col(end).alias("_at"), F.lit(None).cast("bigint").alias("_start"), F.struct(*rows.columns).alias("_row"))
    starts = rows.select(*keys, F.col(start).alias("_at"), F.col(start).cast("bigint").alias("_start"), F.lit(None).cast(points.schema["_row"].dataType).alias("_row"))
    # At equal places an end comes first, so that a start there is after it.
    w = Window.partitionBy(*keys).orderBy("_at", F.col("_start").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    nearest = F.first("_start", ignorenulls=True).over(w)
    swept = points.unionByName(starts).withColumn("_next", nearest).where("_row is not null")
    return swept.select("_row.*", (F.coalesce("_next", F.col(f"_row.{limit}")) - F.col(f"_row.{end}")).alias("gap"))


def stable_position(rows: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Places from 1, by order; the last column of order breaks all ties."""
    return rows.withColumn(out, F.row_number().over(_w(keys, order)).cast("long"))
