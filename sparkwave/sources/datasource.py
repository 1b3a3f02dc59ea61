"""Recordings as a Spark data source: ``spark.read.format("recording").load(uri)``, and as a stream.

    register(spark)
    spark.read.format("recording").option("start", 1000).option("stop", 2000).option("channels", "0,3").load(uri)

Rows, by the option ``rows``: ``samples`` (sample, stamp, channel, value), the default, ``blocks``, one row per packet and
channel, or ``chunks``, blocks cut at multiples of ``chunk_samples``. Options ``start``, ``stop`` and ``channels`` (numbers, by
commas) narrow what is read; ``signal_channels`` "any" accepts other channel counts than the usual one.

The driver reads the segment table and a header. A partition is a share of one segment's packets, by the place of their
bytes, as many as the segment has times ``SPLIT_BYTES``; its task reads that segment's index, checks it, and decodes only
packets that the window touches. With the option ``filters`` "true", conditions on sample, stamp and channel are taken from
Spark's filters, are evaluated here for each row, and shut out segments, packets and channels; all other conditions are left to
Spark. That isn't the default, as Spark 4.1 keeps the filters pushed last with what ``load()`` gave: where that is used again in
the same plan, or later without a condition, it loses rows (``tests/test_datasource.py`` shows it). It's safe only if each
``load()`` is used in one query; options are safe always.

As a stream (rows ``chunks``), an offset is a sample. With ``closed`` "false" the recording may still get segments, and
offsets stand at multiples of ``chunk_samples``, so a batch has whole chunks; otherwise the last offset is the end.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..limits import ReadLimits
from ..session import ship_package
from .recording import decoded_runs, described, filesystem, index_of, refuse, row_runs

NAME = "recording"
SPLIT_BYTES = 32 << 20
#: Samples that a batch of rows has, about.
BATCH_SAMPLES = 1 << 17
SCHEMAS = {
    "samples": "sample long, stamp long, channel int, value long",
    "blocks": "segment_index int, packet_index int, channel int, start_sample long, values array<long>",
    "chunks": "chunk long, channel int, start_sample long, values array<long>",
}


def rows_of(options: dict[str, str]) -> str:
    rows = options.get("rows", "samples")
    if rows not in SCHEMAS:
        raise ValueError(f"rows must be one of {', '.join(SCHEMAS)}")
    return rows


def register(spark: SparkSession, source: type[DataSource] | None = None) -> None:
    """Make the format, or another of this package, known to a session, and let loads that say so take filters.

    A stream is planned by a Python process beside the driver that gets no files which were sent to workers, so the format
    is registered with the place of this package on its path.
    """
    ship_package(spark)
    environment, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    before = environment.get("PYTHONPATH")
    environment["PYTHONPATH"] = os.pathsep.join(filter(None, [here, before]))
    try:
        spark.dataSource.register(source or RecordingSource)
    finally:
        environment.pop("PYTHONPATH")
        if before is not None:
            environment["PYTHONPATH"] = before
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


@dataclass(frozen=True)
class Window:
    """What is asked for: samples [start, stop), both open if None, and stamps alike; channels, all if None."""

    start: int | None = None
    stop: int | None = None
    first_stamp: int | None = None
    last_stamp: int | None = None
    channels: frozenset[int] | None = None

    def narrowed(self, condition: Filter) -> Window | None:
        """With a condition, or None if it isn't one that this source evaluates."""
        column = ".".join(condition.attribute) if hasattr(condition, "attribute") else ""
        value = getattr(condition, "value", None)
        if isinstance(condition, IsNotNull) and column in ("sample", "stamp", "channel", "value"):
            return self  # none of these is ever null
        if isinstance(condition, In) and column == "channel" and all(type(v) is int for v in value):
            return replace(self, channels=frozenset(value) & (self.channels if self.channels is not None else frozenset(value)))
        if type(value) is not int:
            return None
        if isinstance(condition, EqualTo) and column == "channel":
            return replace(self, channels=frozenset([value]) & (self.channels if self.channels is not None else frozenset([value])))
        low, high = {EqualTo: (value, value), GreaterThan: (value + 1, None), GreaterThanOrEqual: (value, None), LessThan: (None, value - 1), LessThanOrEqual: (None, value)}.get(type(condition), (None, None))
        if low is None and high is None:
            return None
        most = lambda a, b: b if a is None else a if b is None else max(a, b)
        least = lambda a, b: b if a is None else a if b is None else min(a, b)
        if column == "sample":
            return replace(self, start=most(self.start, low), stop=least(self.stop, None if high is None else high + 1))
        if column == "stamp":
            return replace(self, first_stamp=most(self.first_stamp, low), last_stamp=least(self.last_stamp, high))
        return None

    def bounds(self, origin: int, n_samples: int) -> tuple[int, int]:
        start = max(0, self.start or 0, (self.first_stamp if self.first_stamp is not None else origin) - origin)
        stops = [n_samples, n_samples if self.stop is None else self.stop, n_samples if self.last_stamp is None else self.last_stamp - origin + 1]
        return start, max(start, min(stops))


@dataclass
class Share(InputPartition):
    """A segment, its share ``number`` of ``of``, and the samples [start, stop)."""

    segment: dict
    number: int
    of: int
    start: int
    stop: int


class Source:
    """A recording, what is asked of it, and how its packets become rows; needs no session."""

    def __init__(self, options: dict[str, str]):
        self.uri, self.rows = options["path"], rows_of(options)
        self.chunk = int(options.get("chunk_samples", 20_480))
        if self.chunk < 1:
            raise ValueError("chunk_samples must be positive")
        self.known = {"channels": None} if options.get("signal_channels") == "any" else {}
        self.limits = ReadLimits(**{k: int(options[k]) for k, _ in ReadLimits().items() if k in options})
        number = lambda name: int(options[name]) if name in options else None
        chosen = options.get("channels")
        self.window = Window(number("start"), number("stop"), channels=None if chosen is None else frozenset(map(int, chosen.split(","))))

    def open(self) -> None:
        from . import layout

        _, _, self.header, self.table, self.files, _, _ = described(self.uri, self.limits, self.known.get("channels", layout.RECORDED_CHANNELS))
        self.origin, self.n_samples = self.table[0][1], self.table[-1][2] - self.table[0][1] + 1

    def shares(self, start: int, stop: int) -> list[Share]:
        """The segments that hold any of the samples, in shares of about ``SPLIT_BYTES``."""
        found = []
        for i, ((name, first, last, number, stored), (erd, etc)) in enumerate(zip(self.table, self.files, strict=True)):
            if stored and first - self.origin < stop and last - self.origin >= start:
                fs, path = filesystem(erd)
                n = max(1, -(-fs.get_file_info(path).size // SPLIT_BYTES))
                row = {"segment_index": i, "segment_name": name, "start_stamp": first, "end_stamp": last, "sample_number": number, "stored_samples": stored, "erd": erd, "etc": etc}
                found += [Share(row, k, n, start, stop) for k in range(n)]
        return found

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        entries, ends, data = index_of(share.segment, self.limits, self.header)
        refuse(share.segment, entries, ends, data, self.limits, self.header)
        at, spans = entries["stamp"].astype(np.int64) - self.origin, entries["span"].astype(np.int64)
        mine = entries["offset"].astype(np.int64) * share.of // max(1, data.size) == share.number
        touched = np.flatnonzero(mine & (at < share.stop) & (at + spans > share.start))
        rows = ({"segment_index": share.segment["segment_index"], "packet_index": i, "byte_offset": int(entries["offset"][i]), "byte_end": int(ends[i]), "sample_stamp": int(entries["stamp"][i]), "sample_span": int(spans[i]), "erd": share.segment["erd"], "file_size": data.size, "modified": data.mtime_ns} for i in touched.tolist())
        wanted = None if self.window.channels is None else sorted(self.window.channels)
        for found in decoded_runs(row_runs(rows), np.array(self.header.shorted), self.origin, share.start, share.stop, wanted):
            yield from {"samples": self.samples, "blocks": self.blocks, "chunks": self.chunks}[self.rows](*found)

    def samples(self, rows: list[dict], starts: list[int], own: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for start, v in zip(starts, values, strict=True):
            held.append((np.tile(np.arange(start, start + v.shape[1]), len(own)), np.repeat(own, v.shape[1]), v.ravel()))
            size += v.size
            if size >= BATCH_SAMPLES or v is values[-1]:
                sample, channel, value = (np.concatenate(x) for x in zip(*held, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(sample), pa.array(sample + self.origin), pa.array(channel.astype(np.int32)), pa.array(value)], names=["sample", "stamp", "channel", "value"])
                held, size = [], 0

    def blocks(self, rows: list[dict], starts: list[int], own: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for row, start, v in zip(rows, starts, values, strict=True):
            n = len(own)
            yield pa.RecordBatch.from_arrays([pa.array([row["segment_index"]] * n, pa.int32()), pa.array([row["packet_index"]] * n, pa.int32()), pa.array(own.astype(np.int32)), pa.array([start] * n, pa.int64()), lists_of([v])], names=["segment_index", "packet_index", "channel", "start_sample", "values"])

    def chunks(self, rows: list[dict], starts: list[int], own: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pieces = []
        for start, v in zip(starts, values, strict=True):
            edges = [start, *range((start // self.chunk + 1) * self.chunk, start + v.shape[1], self.chunk), start + v.shape[1]]
            pieces += [(a, v[:, a - start : b - start]) for a, b in zip(edges, edges[1:], strict=False) if b > a]
        if pieces:
            at, n = np.array([a for a, _ in pieces]), len(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at // self.chunk, n)), pa.array(np.tile(own, len(pieces)).astype(np.int32)), pa.array(np.repeat(at, n)), lists_of([v for _, v in pieces])], names=["chunk", "channel", "start_sample", "values"])


def lists_of(values: list[np.ndarray]) -> pa.Array:
    """A list for each row of each array."""
    sizes = np.concatenate([np.full(v.shape[0], v.shape[1]) for v in values])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate([v.ravel() for v in values])))


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.source = Source(options)

    def partitions(self) -> Sequence[InputPartition]:
        self.source.open()
        return self.source.shares(*self.source.window.bounds(self.source.origin, self.source.n_samples)) or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Share):
            if not hasattr(self.source, "header"):
                self.source.open()
            yield from self.source.read(partition)


class FilteredReader(RecordingReader):
    """For loads that are used in one query only."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            narrowed = self.source.window.narrowed(condition)
            if narrowed is None or self.source.rows != "samples" and getattr(condition, "attribute", None) != ("channel",):
                yield condition
            else:
                self.source.window = narrowed


class RecordingStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.source = Source({"rows": "chunks"} | options)
        if self.source.rows != "chunks":
            raise ValueError("a stream has rows of chunks")
        self.closed = options.get("closed", "true") != "false"

    def initialOffset(self) -> dict:
        return {"sample": 0}

    def latestOffset(self) -> dict:
        self.source.open()
        end = self.source.n_samples
        return {"sample": end if self.closed else end - end % self.source.chunk}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.source.open()
        return self.source.shares(start["sample"], end["sample"]) or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Share):
            if not hasattr(self.source, "header"):
                self.source.open()
            yield from self.source.read(partition)


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMAS[rows_of(self.options)]

    def reader(self, schema) -> DataSourceReader:
        return (FilteredReader if self.options.get("filters") == "true" else RecordingReader)(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RecordingStream(dict(self.options))
