"""Ranges of samples: islands, gaps, interval joins, as-of lookups and fixed-size chunks.

All ranges are half-open. Windows run within partitions that the caller names, so recordings stay independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scan


def islands(ranges: DataFrame, by: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """Adjacent ranges merged: (``by``, start, stop). Overlaps are for the caller to refuse; they merge here."""
    order = Window.partitionBy(*by).orderBy(start, stop)
    reach = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    numbered = marked.withColumn("_island", F.sum("_new").over(order))
    return numbered.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("_island")


def clipped(ranges: DataFrame, low: int, high: int, start: str = "start", stop: str = "stop") -> DataFrame:
    """The parts of ranges inside [low, high)."""
    inside = ranges.where((F.col(stop) > low) & (F.col(start) < high))
    return inside.withColumn(start, F.greatest(F.col(start), F.lit(low))).withColumn(stop, F.least(F.col(stop), F.lit(high)))


def overlaps(ranges: DataFrame, by: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """Ranges that begin before one that starts earlier has ended."""
    order = Window.partitionBy(*by).orderBy(start, stop).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.where(F.col(start) >= 0).withColumn("_reach", F.max(stop).over(order)).where(F.col(start) < F.col("_reach")).drop("_reach")


def gaps(stored: DataFrame, by: list[str], low: int, high: int, keys: DataFrame | list[tuple] | None = None) -> DataFrame:
    """(``by``, start, stop) of what ``stored`` islands leave of [low, high), with leading and trailing gaps.

    A key without islands has one gap, all of [low, high), if ``keys`` (``by``) names it; without ``keys`` it isn't known.
    """
    order = Window.partitionBy(*by).orderBy("start")
    edge = stored.select(*by, F.coalesce(F.lag("stop").over(order), F.lit(low)).alias("start"), F.col("start").alias("stop"))
    tail = stored.groupBy(*by).agg(F.max("stop").alias("start")).withColumn("stop", F.lit(high).cast("long"))
    found = edge.unionByName(tail.select(*by, "start", "stop")).where("stop > start")
    if keys is None:
        return found
    if isinstance(keys, list):
        keys = stored.sparkSession.createDataFrame(keys, stored.select(*by).schema)
    empty = keys.select(*by).distinct().join(stored.select(*by), by, "left_anti")
    return found.unionByName(empty.select(*by, F.lit(low).cast("long").alias("start"), F.lit(high).cast("long").alias("stop")).where("stop > start"))


#: Cells of a level are this many times as wide as those of the level below it; levels that 64 bits can need.
BASE, LEVELS = 8, 21


def _cell(at: Column, width: Column) -> Column:
    """The number of the cell of ``width`` that holds ``at``, in whole numbers."""
    return F.call_function("div", at - F.pmod(at, width), width)


def interval_join(left: DataFrame, right: DataFrame, on: list[str], width: int) -> DataFrame:
    """Rows of ``left`` (lo, hi) and ``right`` (start, stop) whose ranges overlap, whatever their lengths.

    Two ranges overlap if and only if the later of their starts lies in the other one. A range takes the one or two cells
    that it touches on the level whose cells are at least as wide as it, ``width`` at level 0 and ``BASE`` times as much a
    level; a start takes its cell on each level that the other side has. So ranges of any length become a few rows, joined
    by equality on (level, cell), and each overlap is found once. A hot cell is split by Spark as any skewed join key.
    """
    widths = [width * BASE**j for j in range(LEVELS) if width * BASE**j < 1 << 62]
    level = lambda a, b: sum(((F.col(b) - F.col(a)) > w).cast("int") for w in widths[:-1])
    wide = lambda j: F.get(F.array(*(F.lit(w).cast("long") for w in widths)), j)

    def cells(rows: DataFrame, a: str, b: str, levels: list[int], inside: int) -> DataFrame:
        """Rows once for each cell of their range, marked ``inside``, and of their start, marked by the other number."""
        ranged = rows.withColumn("_level", level(a, b)).withColumn("_cell", F.explode(F.sequence(_cell(F.col(a), wide(F.col("_level"))), _cell(F.col(b) - 1, wide(F.col("_level"))))))
        starts = rows.withColumn("_level", F.explode(F.lit(levels).cast("array<int>"))).withColumn("_cell", _cell(F.col(a), wide(F.col("_level"))))
        return ranged.withColumn("_kind", F.lit(inside)).unionByName(starts.withColumn("_kind", F.lit(1 - inside)))

    one, two = left.where("hi > lo"), right.where("stop > start")
    levels_of = lambda rows, a, b: sorted(r[0] for r in rows.select(level(a, b)).distinct().collect())  # noqa: E731  LEVELS at most
    met = cells(one, "lo", "hi", levels_of(two, "start", "stop"), 1).join(cells(two, "start", "stop", levels_of(one, "lo", "hi"), 0), [*on, "_kind", "_level", "_cell"])
    found = F.when(F.col("_kind") == 1, (F.col("lo") < F.col("start")) & (F.col("start") < F.col("hi"))).otherwise((F.col("start") <= F.col("lo")) & (F.col("lo") < F.col("stop")))
    return met.where(found).drop("_kind", "_level", "_cell")


def as_of(left: DataFrame, right: DataFrame, on: list[str], at: str, value: list[str]) -> DataFrame:
    """``left`` with the ``value`` columns of the last row of ``right`` at or before ``at`` (null if none).

    Both sides are merged into one order and the last value is carried on in two levels, so a key may hold any share of
    the rows. A row of ``left`` without ``at`` finds none, a row of ``right`` without it is found by none.
    """
    names = left.columns
    marked = left.select(*on, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*names).alias("_source"), *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in value))
    source = right.where(F.col(at).isNotNull()).select(*on, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(marked.schema["_source"].dataType).alias("_source"), *value)
    both = marked.unionByName(source).select(*on, "_at", "_side", F.monotonically_increasing_id().alias("_tie"), "_source", F.when(F.col("_side") == 0, F.struct(*value)).alias("_last"))
    filled = scan.last_values(both, on, ["_at", "_side", "_tie"], "_last")
    return filled.where("_side = 1").select("_source.*", *(F.col(f"_last.{v}").alias(v) for v in value))


def chunk(sample: Column, start: int, size: int) -> Column:
    """The number of the fixed-size chunk from ``start`` on that holds a sample."""
    return F.floor((sample - start) / size)


def stored_ranges(packets: DataFrame, origin: int, by: list[str]) -> DataFrame:
    """The islands that packets (sample_stamp, sample_span) cover, as samples."""
    start = F.col("sample_stamp") - origin
    return islands(packets.select(*by, start.alias("start"), (start + F.col("sample_span")).alias("stop")), by)


def carried(deltas: DataFrame, by: list[str], order: str, delta: str, absolute: str, out: str, *, bounded: bool = False) -> DataFrame:
    """Running sums of ``delta`` that start anew wherever ``absolute`` has a value; null before the first such value.

    Two levels, so a key may hold any share of the rows; ``bounded`` says that keys are small by format, as packets are,
    and takes one window for each.
    """
    if not bounded:
        return scan.carried_sums(deltas, by, [order], delta, absolute, out)
    one = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = deltas.withColumn("_run", F.count(absolute).over(one))
    within = Window.partitionBy(*by, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce(absolute, delta)).over(within)
    return run.withColumn(out, F.when(F.col("_run") > 0, total)).drop("_run")


#: Samples of a gap that are made rows by one row.
PIECE = 4096


def pieces(spark: SparkSession, missing: DataFrame) -> DataFrame:
    """The ranges ``missing`` (channel, start, stop) in pieces of ``PIECE`` samples, dealt to all tasks, so that the rows of a
    channel that has only a gap are spread as well. Stamps have 32 bits, so a gap has half a million pieces at most."""
    cut = missing.where("stop > start").select("channel", F.explode(F.sequence("start", F.col("stop") - 1, F.lit(PIECE).cast("long"))).alias("start"), "stop")
    return cut.repartition(spark.sparkContext.defaultParallelism, "channel", "start").withColumn("stop", F.least(F.col("start") + PIECE, "stop"))


def filled(stored: DataFrame, missing: DataFrame) -> DataFrame:
    """(sample, channel, value) of what is stored, and of every sample of the gaps ``missing`` (channel, start, stop), null.

    Gaps are made rows beside what is stored, so there is no grid to join with and nothing of ``stored`` moves.
    """
    dealt = pieces(stored.sparkSession, missing)
    empty = dealt.select(F.explode(F.sequence("start", F.col("stop") - 1)).alias("sample"), "channel", F.lit(None).cast(stored.schema["value"].dataType).alias("value"))
    return stored.select("sample", "channel", "value").unionByName(empty)


def by_chunk(ranges: DataFrame, size: int) -> DataFrame:
    """(chunk, channel, n): the samples of each range (channel, start, stop) in each chunk of ``size`` that it touches."""
    first, last = chunk(F.col("start"), 0, size), chunk(F.col("stop") - 1, 0, size)
    parts = ranges.where("stop > start").select("channel", "start", "stop", F.explode(F.sequence(first, last)).alias("chunk"))
    return parts.select("chunk", "channel", (F.least("stop", (F.col("chunk") + 1) * size) - F.greatest("start", F.col("chunk") * size)).alias("n"))
