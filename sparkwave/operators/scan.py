"""Scans in two levels: sums and last values along an order in which one key may hold any share of the rows.

Range partitioning on keys and order cuts the rows into slices, so a key with many rows lies in many of them. What a slice's
rows of a key add up to is one small row; windows over these give what each slice starts with, which goes before its rows.
So a task has one slice at most, whatever its key, and only rows of the same key, order and tie-break stay together.

The slices are written to the shared scratch folder, as a slice that is cut anew may end elsewhere. Nulls in keys are a key
of their own; nulls in the order come first; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

SLICE, _ROW = "_slice", "_row"


def sliced(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with the number of their slice; numbers rise with (``by``, ``order``)."""
    return materialise(rows.repartitionByRange(*by, *order).withColumn(SLICE, F.spark_partition_id()), "slices")


def _within(by: list[str], order: list[str]) -> Window:
    return Window.partitionBy(SLICE, *by).orderBy(_ROW, *order)


def _earlier(by: list[str]) -> Window:
    """Over a row per slice and key."""
    return Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def _led(placed: DataFrame, carry: DataFrame) -> DataFrame:
    """The rows of slices with what each slice starts with before them."""
    return placed.withColumn(_ROW, F.lit(1)).unionByName(carry.withColumn(_ROW, F.lit(0)), allowMissingColumns=True)


def running_sums(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with a column for each of ``sums``: the sum of its values over the rows of the key that come before."""
    placed = sliced(rows.withColumns(sums), by, order)
    totals = placed.groupBy(SLICE, *by).agg(*(F.sum(name).alias(name) for name in sums))
    carry = totals.select(SLICE, *by, *(F.sum(name).over(_earlier(by)).cast(placed.schema[name].dataType).alias(name) for name in sums))
    before = _within(by, order).rowsBetween(Window.unboundedPreceding, -1)
    summed = {name: F.coalesce(F.sum(name).over(before), F.lit(0)).cast(placed.schema[name].dataType) for name in sums}
    return _led(placed, carry).withColumns(summed).where(F.col(_ROW) == 1).drop(SLICE, _ROW)


def last_values(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with nulls of ``value`` replaced by the last value of the key that comes before, null if there is none."""
    placed = sliced(rows, by, order)
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = placed.groupBy(SLICE, *by).agg(F.max_by(value, known).alias(value))
    carry = ends.select(SLICE, *by, F.last(value, ignorenulls=True).over(_earlier(by)).alias(value))
    upto = _within(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return _led(placed, carry).withColumn(value, F.last(value, ignorenulls=True).over(upto)).where(F.col(_ROW) == 1).drop(SLICE, _ROW)


def carried_sums(rows: DataFrame, by: list[str], order: list[str], delta: str, absolute: str, out: str) -> DataFrame:
    """``rows`` with running sums of ``delta`` that start anew wherever ``absolute`` has a value; null before the first.

    The sum at a row is that of all deltas of its key so far, plus the last difference of an absolute value and that sum.
    """
    step = F.coalesce(F.when(F.col(absolute).isNull(), F.col(delta)), F.lit(0)).cast("long")
    summed = running_sums(rows, by, order, {"_before": step})
    total = summed.withColumn("_total", F.col("_before") + step)
    offset = last_values(total.withColumn("_offset", F.col(absolute) - F.col("_total")), by, order, "_offset")
    return offset.withColumn(out, F.col("_total") + F.col("_offset")).drop("_before", "_total", "_offset")
