"""Order-dependent helpers that keep working when one key holds a large share of all rows.

A plain window puts a whole key into one task.  Here the integer order column is cut into
ranges of ``width``; the exact window runs inside a range, and only one summary row per range
reaches the window over the whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


def running_total(df: DataFrame, keys: list[str], order: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """Inclusive running sum of ``value`` per key in ``order``; rows with equal order share a total."""
    ranged = df.withColumn("_range", F.floor(F.col(order) / width))
    sums = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    return (
        ranged.join(offsets, [*keys, "_range"])
        .withColumn(out, F.col("_offset") + F.sum(value).over(inside))
        .drop("_range", "_offset")
    )


def previous(df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int = WIDTH) -> DataFrame:
    """``value`` of the preceding row of the same key (null for the first); ``order`` unique per key."""
    ranged = df.withColumn("_range", F.floor(F.col(order) / width)).withColumn("_value", F.struct(value.alias("v")))
    lasts = ranged.groupBy(*keys, "_range").agg(F.max_by("_value", order).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_range")
    carried = lasts.select(*keys, "_range", F.lag("_last").over(across).alias("_carried"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    return (
        ranged.join(carried, [*keys, "_range"])
        .withColumn(out, F.coalesce(F.lag("_value").over(inside), F.col("_carried"))["v"])
        .drop("_range", "_value", "_carried")
    )


def carried(df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int = WIDTH) -> DataFrame:
    """The last value that isn't null at or before each row of its key (null before the first); ``order`` unique per key."""
    ranged = df.withColumn("_range", F.floor(F.col(order) / width)).withColumn("_value", F.when(value.isNotNull(), F.struct(value.alias("v"))))
    lasts = ranged.groupBy(*keys, "_range").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lasts.select(*keys, "_range", F.last("_last", ignorenulls=True).over(before).alias("_earlier"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.join(earlier, [*keys, "_range"])
        .withColumn(out, F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_earlier"))["v"])
        .drop("_range", "_value", "_earlier")
    )


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str, width: int = WIDTH) -> DataFrame:
    """Row number (from 1) per key in ascending ``order``, whose last column is an integer and makes rows different.

    The window runs inside ranges of that integer (of equal other order columns); one count per range carries over.
    """
    *coarse, fine = order
    ranged = df.withColumn("_range", F.floor(F.col(fine) / width))
    groups = [*keys, *coarse, "_range"]
    before = Window.partitionBy(*keys).orderBy(*coarse, "_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*groups, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*groups).orderBy(fine)
    return (
        ranged.withColumn("_local", F.row_number().over(inside))
        .join(offsets, groups)
        .withColumn(out, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_range", "_local", "_before")
    )
