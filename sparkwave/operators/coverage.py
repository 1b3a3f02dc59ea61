"""Coverage of a recording: what ``validate`` reports, from metadata alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataIntegrityError
from ..sources.recording import Recording
from . import ranges


def _by_segment(recording: Recording) -> tuple[DataFrame, DataFrame]:
    """Islands of stored samples within each segment, and a row (segment_index, first, last) for each segment that has any.

    The second has a row per segment, which the budget of segments bounds, so it may be broadcast and pass through one task.
    """
    inside = ranges.stored_ranges(recording.packets(), recording.origin, ["segment_index"])
    return inside, inside.groupBy("segment_index").agg(F.min("start").alias("first"), F.max("stop").alias("last"))


def ranges_of(recording: Recording, start: int = 0, stop: int | None = None) -> DataFrame:
    """Stored ranges (start, stop) inside a window. Only a segment's first and last range can go on in another segment."""
    start, stop = recording.window(start, stop)
    inside, ends = _by_segment(recording)
    marked = inside.join(F.broadcast(ends), "segment_index")
    at_end = (F.col("start") == F.col("first")) | (F.col("stop") == F.col("last"))
    merged = ranges.islands(marked.where(at_end).select(F.lit(1).alias("one"), "start", "stop"), ["one"]).drop("one")
    return ranges.clipped(marked.where(~at_end).select("start", "stop").unionByName(merged), start, stop)


def missing_of(recording: Recording) -> DataFrame:
    """Gaps (start, stop) of a recording: within segments, and before, between and after them; all of it if none is stored."""
    inside, ends = _by_segment(recording)
    order = Window.partitionBy("segment_index").orderBy("start")
    within = inside.select(F.lag("stop").over(order).alias("start"), F.col("start").alias("stop")).where("start is not null")
    outer = ranges.gaps(ends.select(F.lit(1).alias("one"), F.col("first").alias("start"), F.col("last").alias("stop")), ["one"], 0, recording.n_samples, [(1,)])
    return within.unionByName(outer.drop("one"))


def _missing_by_channel(r: Recording) -> DataFrame:
    """(channel, start, stop) of what isn't stored: the gaps of each channel, and all of a shorted one."""
    gaps = missing_of(r).select(F.explode(F.lit([c for c, off in enumerate(r.header.shorted) if not off]).cast("array<int>")).alias("channel"), "start", "stop")
    whole = r.spark.createDataFrame([(c, 0, r.n_samples) for c, off in enumerate(r.header.shorted) if off], "channel int, start long, stop long")
    return gaps.unionByName(whole)


def filled_samples(recording: Recording) -> DataFrame:
    """(sample, channel, value) of all logical samples of all channels: null in gaps and on shorted channels."""
    r = recording.indexed()
    return ranges.filled(r.samples(), _missing_by_channel(r))


def _lengths(recording: Recording) -> tuple[DataFrame, DataFrame]:
    """Ranges (channel, start, stop) of stored samples, a row per decoded block, and of missing ones, in pieces."""
    r = recording.indexed()
    stored = r.blocks().select("channel", F.col("start_sample").alias("start"), (F.col("start_sample") + F.size("values")).alias("stop"))
    return stored, ranges.pieces(r.spark, _missing_by_channel(r))


def _summed(stored: DataFrame, missing: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, stored, missing): sums of ``n`` of both."""
    none = F.lit(0).cast("long")
    both = stored.select(*by, F.col("n").alias("stored"), none.alias("missing")).unionByName(missing.select(*by, none.alias("stored"), F.col("n").alias("missing")))
    return both.groupBy(*by).agg(F.sum("stored").alias("stored"), F.sum("missing").alias("missing"))


def chunk_counts(recording: Recording, size: int) -> DataFrame:
    """(chunk, channel, stored, missing) samples of chunks of ``size``, from decoded blocks and gaps, without a row a sample."""
    return _summed(*(ranges.by_chunk(x, size) for x in _lengths(recording)), ["chunk", "channel"])


def channel_counts(recording: Recording) -> DataFrame:
    """(channel, stored, missing) samples, in the same way."""
    return _summed(*(x.select("channel", (F.col("stop") - F.col("start")).alias("n")) for x in _lengths(recording)), ["channel"])


def validate(recording: Recording) -> DataFrame:
    """One row: segments, packets, logical, stored and missing samples (also by place), notes, events, unparsed notes."""
    packets = recording.packets()  # reading it makes the checks of each segment's index
    n = recording.n_samples
    size = F.col("stop") - F.col("start")
    sums = missing_of(recording).agg(F.coalesce(F.sum(F.when(F.col("start") == 0, size)), F.lit(0)).alias("missing_leading"), F.coalesce(F.sum(F.when(F.col("stop") == n, size)), F.lit(0)).alias("missing_trailing"), F.coalesce(F.sum(size), F.lit(0)).alias("missing_samples"))
    counts = packets.agg(F.count("*").alias("packets"), F.coalesce(F.sum("sample_span"), F.lit(0)).alias("stored_samples"))
    notes = recording.notes().agg(F.count("*").alias("notes"), F.count_if(F.col("value").isNull()).alias("unparsed_notes"))
    events = recording.events().agg(F.count("*").alias("events"))
    row = counts.crossJoin(sums).crossJoin(notes).crossJoin(events).first()  # single rows
    if row["stored_samples"] + row["missing_samples"] != n:
        raise DataIntegrityError("stored and missing samples don't add up")
    out = {"segments": len(recording.table), "logical_samples": n, **row.asDict()}
    return recording.spark.createDataFrame([tuple(out.values())], ", ".join(f"{k} long" for k in out))


def channel_range(samples: DataFrame) -> DataFrame:
    """(channel, low, high, n) of stored counts; partial in each task, so one small shuffle."""
    return samples.groupBy("channel").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


def block_range(blocks: DataFrame) -> DataFrame:
    """The same from blocks, without exploding them."""
    per = blocks.select("channel", F.array_min("values").alias("low"), F.array_max("values").alias("high"), F.size("values").alias("n"))
    return per.groupBy("channel").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
