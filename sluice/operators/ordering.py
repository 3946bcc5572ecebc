"""Positions, running totals and as-of values in a total order, without one task for all rows.

Rows are dealt by ranges of the order, sorted and numbered within their range, and written once, so that the ranges stay
as they are. What a range needs of the ranges before it is a row for each range, which is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.names import free_names
from sluice.sources.shared import written


def in_ranges(df: DataFrame, order: tuple[str | Column, ...], range_: str, at: str) -> DataFrame:
    """df dealt by ranges of the order, with the number of each row's range and its place there (from 0)."""
    (both,) = free_names([*df.columns, range_, at], "both")
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(both, F.monotonically_increasing_id())
    return written(numbered.select(*[F.col(f"`{c}`") for c in df.columns], F.shiftright(both, 33).alias(range_), F.col(both).bitwiseAND((1 << 33) - 1).alias(at)), "ranges")


def with_position(df: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """df with its 1-based position in the total order of the given columns."""
    range_, at, n, before = free_names([*df.columns, name], "range", "at", "n", "before")
    placed = in_ranges(df, order, range_, at)
    counts = placed.groupBy(range_).agg(F.count("*").alias(n))
    earlier = counts.select(range_, (F.sum(n).over(Window.orderBy(range_)) - F.col(n)).alias(before))
    return placed.join(F.broadcast(earlier), range_).withColumn(name, F.col(at) + F.col(before) + 1).drop(range_, at, before)


def position_in(df: DataFrame, key: str, *order: str | Column, name: str = "pos", count: str = "n") -> DataFrame:
    """df with its 1-based position among the rows of its key, and how many these are. A key with many rows is split over
    ranges: what its rows are told is found by range and key."""
    range_, at, whole, least, own, first, n = free_names([*df.columns, name, count], "range", "at", "whole", "least", "own", "first", "n")
    ranged = in_ranges(df, (key, *order), range_, at)
    counts = ranged.groupBy(range_, key).agg(F.count("*").alias(own), F.min(at).alias(least))
    by_key = Window.partitionBy(key)
    earlier = F.coalesce(F.sum(own).over(by_key.orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = counts.select(F.col(range_).alias(first), F.col(key).alias(whole), (earlier - F.col(least)).alias(n), F.sum(own).over(by_key).alias(count))
    joined = ranged.join(told, (F.col(range_) == F.col(first)) & F.col(key).eqNullSafe(F.col(whole)))
    return joined.withColumn(name, F.col(at) + F.col(n) + 1).select(*[F.col(f"`{c}`") for c in df.columns], name, count)


def running_total(df: DataFrame, value: str, *order: str | Column, name: str) -> DataFrame:
    """df with the sum of value up to each row in the total order, the row included."""
    range_, at, n, before = free_names([*df.columns, name], "range", "at", "n", "before")
    placed = in_ranges(df, order, range_, at)
    sums = placed.groupBy(range_).agg(F.coalesce(F.sum(value), F.lit(0)).alias(n))
    earlier = sums.select(range_, (F.sum(n).over(Window.orderBy(range_)) - F.col(n)).alias(before))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(range_).orderBy(at)), F.lit(0))
    return placed.withColumn(name, own).join(F.broadcast(earlier), range_).withColumn(name, F.col(name) + F.col(before)).drop(range_, at, before)


def carried(df: DataFrame, value: str, *order: str | Column) -> DataFrame:
    """df with value replaced by the last value that is not null up to each row in the total order."""
    range_, at, last, before = free_names(df.columns, "range", "at", "last", "before")
    placed = in_ranges(df, order, range_, at)
    lasts = placed.where(F.col(value).isNotNull()).groupBy(range_).agg(F.max_by(value, at).alias(last))
    every = placed.select(range_).distinct().join(F.broadcast(lasts), range_, "left")
    earlier = every.select(range_, F.last(last, ignorenulls=True).over(Window.orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)).alias(before))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy(range_).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(value, own).join(F.broadcast(earlier), range_).withColumn(value, F.coalesce(value, before)).select(*[F.col(f"`{c}`") for c in df.columns])
