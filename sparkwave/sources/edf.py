"""EDF+ files: encoding, writing, reading and verification as Spark jobs.

A record's place in the file follows from its number, so tasks write and read byte ranges of one file. Paths are of a
file system that all tasks share.
"""

from __future__ import annotations

import os
import sys
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass
from datetime import timedelta, timezone
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataIntegrityError, UnsupportedFormatError
from ..functions import exact, signal
from ..plans.edf import EdfPlan, plan, tal
from ..session import ship_package
from .edf_store import FILE_FIELDS, MANIFEST, SIGNAL_FIELDS, Stored, record_batch
from .layout import SIGNAL_CHANNELS, UV_PER_COUNT
from .recording import Recording

MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
RECORDS = "record long, payload binary"
TASK_BYTES = 16 << 20


def field(value: object, width: int) -> bytes:
    text = str(value).encode("ascii")
    if len(text) > width:
        raise UnsupportedFormatError("a header field is too long")
    return text.ljust(width)


def header(p: EdfPlan, kinds: list[signal.Signal]) -> bytes:
    local = exact.to_datetime(p.header_ticks, timezone(timedelta(seconds=p.offset_seconds)))
    day = f"Startdate {local.day:02d}-{MONTHS[local.month - 1]}-{local.year} X X X"
    head = (0, "X X X X", day, f"{local:%d.%m.%y}", f"{local:%H.%M.%S}", p.header_bytes, p.format, p.records, p.duration, len(p.channels) + 1)
    columns = (
        [*p.labels, signal.ANNOTATIONS], [""] * (len(p.channels) + 1), [*(k.unit for k in kinds), ""],
        [*(k.physical[0] for k in kinds), -1], [*(k.physical[1] for k in kinds), 1], [*(k.digital[0] for k in kinds), signal.DIGITAL_MIN], [*(k.digital[1] for k in kinds), signal.DIGITAL_MAX],
        [""] * (len(p.channels) + 1), [*[p.grid.points] * len(p.channels), p.slot // 2], [""] * (len(p.channels) + 1),
    )
    return b"".join(map(field, head, FILE_FIELDS)) + b"".join(field(v, w) for w, values in zip(SIGNAL_FIELDS, columns, strict=True) for v in values)


def kinds_of(recording: Recording, p: EdfPlan, max_error: float) -> list[signal.Signal]:
    """From one pass over the stored samples: their range by channel."""
    seen = {r["channel"]: (r["low"], r["high"]) for r in recording.ranges(p.start, p.stop, list(p.channels)).collect()}
    scale = lambda c: UV_PER_COUNT if c < SIGNAL_CHANNELS else None
    return [signal.signal_of(c, recording.header.shorted[c], scale(c), *seen.get(c, (0, 0)), max_error) for c in p.channels]


def stretches(starts: list[int], values: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Packets that follow one another without a gap, as one array (channels, samples) each."""
    first = 0
    for i in range(1, len(starts) + 1):
        if i == len(starts) or starts[i] != starts[i - 1] + values[i - 1].shape[1]:
            joined = np.concatenate(values[first:i], axis=1)
            if joined.shape[1]:
                yield starts[first], joined
            first = i


def places_of(p: EdfPlan, channels: np.ndarray) -> list[int]:
    """Where the channels stand in the file."""
    place = {c: i for i, c in enumerate(p.channels)}
    return [place[c] for c in channels.tolist()]


def notes_of(p: EdfPlan) -> dict[int, bytes]:
    """The events of each record that has any."""
    out: dict[int, bytes] = {}
    for record, (_, text) in zip(p.grid.record_of([at for at, _ in p.events]).tolist() if p.events else [], p.events, strict=True):
        out[record] = out.get(record, b"") + text
    return out


def encoded(recording: Recording, p: EdfPlan, kinds: list[signal.Signal]) -> DataFrame:
    """(record, payload) of every record: its channels' codes and its annotations.

    Stretches of samples are quantised and cut at record borders where they are decoded, all channels together; a
    record's pieces, of which each packet gives one at most, meet in one shuffle.
    """
    shorted = np.array([bool(recording.header.shorted[c]) for c in p.channels])
    points, texts, grid = p.grid.points, notes_of(p), p.grid

    def cut(_, starts: list[int], own: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        places, rows = places_of(p, own), []
        for at, counts in stretches(starts, values):
            codes = np.stack([signal.codes_of(c, kinds[i]) for c, i in zip(counts, places, strict=True)])[np.argsort(places)]
            record, offset = grid.place(at - p.start)
            edges = np.arange(-offset, codes.shape[1], points)
            for i, edge in enumerate(edges.tolist()):
                part = codes[:, max(edge, 0) : edge + points]
                rows.append((record + i, max(-edge, 0), part.tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["record", "offset", "data"])

    cuts = recording.decoded(cut, "record long, offset int, data binary", p.start, p.stop, list(p.channels))
    found = cuts.groupBy("record").agg(F.collect_list(F.struct("offset", "data")).alias("pieces"))
    every = recording.spark.range(p.records).select(F.col("id").alias("record")).join(found, "record", "left")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = np.flatnonzero(~shorted)
        for batch in batches:
            payloads = []
            for record, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = np.full((len(shorted), points), signal.DISCONNECTED, dtype="<i2")
                filled = np.zeros(points, dtype=int)
                for piece in own or []:
                    part = np.frombuffer(piece["data"], "<i2").reshape(len(live), -1)
                    columns = slice(piece["offset"], piece["offset"] + part.shape[1])
                    codes[live, columns] = part
                    filled[columns] += 1
                if len(live) and (filled != 1).any():
                    raise DataIntegrityError(f"record {record} isn't filled")
                notes = tal(p.origin + int(p.grid.start_of(record)) / p.rate) + texts.get(record, b"")
                payloads.append(codes.tobytes() + notes.ljust(p.slot, b"\0"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(payloads, pa.binary())], names=["record", "payload"])

    return every.mapInArrow(build, RECORDS)


@dataclass(frozen=True)
class EdfResult:
    path: str
    format: str
    records: int
    output_bytes: int
    stored_samples: int
    max_error: float
    scan_seconds: float
    write_seconds: float
    verify_seconds: float
    logical_samples: int
    stored_ranges: tuple[tuple[int, int], ...]
    gap_seconds: Fraction
    #: (channel, label, unit) in the file's order, and which of these are disconnected.
    channels: tuple[tuple[int, str, str], ...]
    shorted_channels: tuple[int, ...]
    event_count: int


def told(progress: object) -> Callable[[dict], None] | None:
    """What to call with each event: nothing for False and None, a line on the console for True."""
    if progress is None or progress is False:
        return None
    if progress is True:
        return lambda event: print("EDF export:", ", ".join(f"{k} {v}" for k, v in event.items()), file=sys.stderr)
    if not callable(progress):
        raise TypeError("progress must be True, False, None or callable")
    return progress


def watched(spark: SparkSession, stage: str, tell: Callable[[dict], None] | None, action: Callable[[], object]) -> object:
    """The action's result; while its jobs run, ``tell`` gets the tasks that are done and known, in the caller's thread.

    If ``tell`` raises, the jobs are cancelled and the exception goes on.
    """
    if tell is None:
        return action()
    group, context = f"sparkwave-{stage}-{uuid.uuid4().hex}", spark.sparkContext
    tracker = context.statusTracker()

    def run() -> object:
        context.setJobGroup(group, f"EDF export: {stage}")
        return action()

    with ThreadPoolExecutor(1) as one:
        result, before = one.submit(run), None
        try:
            while not result.done():
                wait([result], timeout=0.5)
                infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
                now = (sum(i.numCompletedTasks for i in infos if i), sum(i.numTasks for i in infos if i))
                if now != before and not result.done():
                    before = now
                    tell({"stage": stage, "tasks": now[0], "of": now[1]})
        except BaseException:
            context.cancelJobGroup(group)
            raise
        return result.result()


def probe(folder: str, most: int) -> None:
    """Refuse a folder in which a finished file couldn't be given its name, or that has no room, before any work is done."""
    name = os.path.join(folder, f".publish-{uuid.uuid4().hex}")
    try:
        with open(name, "xb"):
            pass
        os.link(name, f"{name}.link")
    finally:
        for path in (f"{name}.link", name):
            if os.path.lexists(path):
                os.unlink(path)
    free = os.statvfs(folder)
    if free.f_bavail * free.f_frsize < most:
        raise OSError("not enough space for the file")


def publish(partial: str, path: str) -> None:
    """Give a finished file its name, which must be free, and make the folder's entry last."""
    os.link(partial, path)
    folder = os.open(os.path.dirname(os.path.abspath(path)), os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def export(recording: Recording, path: str, *, max_error: float = 0.5, progress: object = None, **options) -> EdfResult:
    """Write an EDF+C or EDF+D file, compare all of it with the source, and only then give it its name.

    Tasks write their records to their places in a file of another name; whatever fails before the last step, a task, a
    callback, a change of the source or a name that is taken meanwhile, only that file was touched, and it goes. An
    existing file is never replaced. ``options`` are those of the plan. ``progress`` is called with the tasks done of each
    stage (range_scan, write, verify), its samples or records at its end, and before the file is published.
    """
    tell = told(progress)
    if not path.casefold().endswith(".edf"):
        raise ValueError("the path must end in .edf")
    if os.path.lexists(path):
        raise FileExistsError(path)
    folder = os.path.dirname(os.path.abspath(path))
    probe(folder, 0)
    before = _signatures(recording)

    def stage(**event) -> None:
        """Tell, and look whether the source is still what it was, also after what was told may have changed it."""
        if tell:
            tell(event)
        if _signatures(recording) != before:
            raise DataIntegrityError("the recording changed while it was exported")

    recording, spark = recording.indexed(), recording.spark
    p = plan(recording, **options)
    stage(stage="planned", records=p.records, file_bytes=p.output_bytes)
    probe(folder, p.output_bytes)
    times = [time.monotonic()]
    kinds = watched(spark, "range_scan", tell, lambda: kinds_of(recording, p, max_error))
    stage(stage="range_scan", samples=p.stored_samples, total=p.stored_samples)
    times.append(time.monotonic())
    partial = f"{path}.partial-{uuid.uuid4().hex}"
    records = encoded(recording, p, kinds)
    try:
        with open(partial, "xb") as f:
            f.write(header(p, kinds))
            f.truncate(p.output_bytes)

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = 0
            with open(partial, "r+b") as f:
                for batch in batches:
                    for record, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        f.seek(p.header_bytes + record * p.record_bytes)
                        f.write(payload)
                        n += 1
                f.flush()
                os.fsync(f.fileno())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

        written = watched(spark, "write", tell, lambda: records.mapInArrow(put, "n long").agg(F.sum("n")).first()[0])
        if written != p.records:
            raise DataIntegrityError("some records weren't written")
        stage(stage="write", records=written, total=p.records)
        times.append(time.monotonic())
        error = watched(spark, "verify", tell, lambda: verify(recording, partial, p, kinds))
        stage(stage="verify", records=p.records, total=p.records)
        times.append(time.monotonic())
        stage(stage="publishing", file_bytes=p.output_bytes)
        publish(partial, path)
    finally:
        if os.path.lexists(partial):
            os.unlink(partial)
    spent = [b - a for a, b in zip(times, times[1:], strict=False)]
    labels = tuple((c, label, k.unit) for c, label, k in zip(p.channels, p.labels, kinds, strict=True))
    shorted = tuple(c for c in p.channels if recording.header.shorted[c])
    spans = tuple((int(a), int(b)) for a, b in p.grid.spans)
    gap = Fraction(spans[-1][1] - spans[0][0]) / p.rate - p.stored_seconds
    return EdfResult(path, p.format, p.records, p.output_bytes, p.stored_samples, error, *spent, p.stop - p.start, spans, gap, labels, shorted, len(p.events))


def _signatures(recording: Recording) -> list:
    from .recording import filesystem

    paths = [x for pair in recording.files for x in pair] + [x for x in (recording.notes_path, recording.clock_path) if x]
    infos = [fs.get_file_info(p) for fs, p in map(filesystem, paths)]
    return [(i.path, i.size, i.mtime_ns) for i in infos]


def verify(recording: Recording, path: str, p: EdfPlan, kinds: list[signal.Signal], manifest: str = MANIFEST) -> float:
    """The largest difference between the file and the source, which is decoded again; refused if anything is wrong.

    The header is compared as bytes, annotations and disconnected channels by record with the plan's, and every code with
    its count, by the task that decodes the count (no shuffle): what the code stands for may differ by half a step. Packets
    don't overlap, so all codes were compared if as many were as the file holds.
    """
    stored = Stored.open(path, manifest)
    if stored.head.data != header(p, kinds):
        raise DataIntegrityError("the file's header is wrong")
    shorted = np.array([bool(recording.header.shorted[c]) for c in p.channels])
    points, texts, grid, size = p.grid.points, notes_of(p), p.grid, 2 * p.grid.points * len(p.channels)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = wrong = 0
        for batch in batches:
            for record, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = np.frombuffer(payload, "<i2", size // 2).reshape(len(shorted), points)
                notes = tal(p.origin + int(grid.start_of(record)) / p.rate) + texts.get(record, b"")
                good = payload[size:] == notes.ljust(p.slot, b"\0") and bool((codes[shorted] == signal.DISCONNECTED).all())
                records, wrong = records + 1, wrong + (not good)
        yield pa.RecordBatch.from_arrays([pa.array([records], pa.int64()), pa.array([wrong], pa.int64())], names=["records", "wrong"])

    there = raw_records(recording.spark, stored)
    records, wrong = there.mapInArrow(marks, "records long, wrong long").agg(F.sum("records"), F.sum("wrong")).first()
    if records != p.records or wrong:
        raise DataIntegrityError(f"{wrong} records differ in their annotations or disconnected channels")

    def compare(_, starts: list[int], own: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        places, compared, wrong, most = places_of(p, own), 0, 0, 0.0
        with stored.reader() as read:
            for at, counts in stretches(starts, values):
                record, offset = grid.place(at - p.start)
                n = -(-(offset + counts.shape[1]) // points)
                raw = np.frombuffer(read(record, n), np.uint8).reshape(n, p.record_bytes)[:, :size]
                codes = np.ascontiguousarray(raw).view("<i2").reshape(n, len(shorted), points)
                for place, own_counts in zip(places, counts, strict=True):
                    errors = signal.errors_of(codes[:, place].ravel()[offset : offset + len(own_counts)], own_counts, kinds[place])
                    wrong += int((errors > kinds[place].half_step * (1 + 1e-9)).sum())
                    compared, most = compared + len(own_counts), max(most, float(errors.max()))
        yield pa.RecordBatch.from_arrays([pa.array([compared], pa.int64()), pa.array([wrong], pa.int64()), pa.array([most])], names=["compared", "wrong", "most"])

    seen = recording.decoded(compare, "compared long, wrong long, most double", p.start, p.stop, list(p.channels))
    compared, wrong, most = seen.agg(F.coalesce(F.sum("compared"), F.lit(0)), F.coalesce(F.sum("wrong"), F.lit(0)), F.coalesce(F.max("most"), F.lit(0.0))).first()
    if wrong or compared != p.records * points * int((~shorted).sum()):
        raise DataIntegrityError(f"{wrong} of {compared} codes differ from the source")
    return most


def raw_records(spark: SparkSession, stored: Stored) -> DataFrame:
    """(record, payload) of every record; a task reads about ``TASK_BYTES``."""
    count, width = stored.head.records, stored.head.record_bytes
    per = max(1, TASK_BYTES // max(1, width))
    ranges = spark.range(0, count, per, max(1, -(-count // per)))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with stored.reader() as read:
            for batch in batches:
                for first in batch.column(0).to_pylist():
                    yield record_batch(first, read(first, min(count, first + per) - first), width)

    return ranges.mapInArrow(get, RECORDS)


@dataclass(frozen=True)
class EdfFile:
    """A readable EDF+ file: header fields, and signals and annotations as DataFrames."""

    spark: SparkSession
    path: str
    stored: Stored

    @staticmethod
    def open(spark: SparkSession, path: str) -> EdfFile:
        """Of a file or a folder of parts, by URI or path."""
        ship_package(spark)
        return EdfFile(spark, path, Stored.open(path))

    @property
    def file(self) -> tuple[str, ...]:
        return self.stored.head.file

    @property
    def signals(self) -> tuple[tuple[str, ...], ...]:
        return self.stored.head.signals

    @property
    def points(self) -> list[int]:
        return [int(s[8]) for s in self.signals]

    def _raw(self) -> DataFrame:
        return raw_records(self.spark, self.stored)

    def codes(self) -> DataFrame:
        """(record, signal, codes) of the ordinary signals."""
        points, names = self.points, [s[0] for s in self.signals]

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for record, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    every, out, at = np.frombuffer(payload, "<i2"), [], 0
                    for i, n in enumerate(points):
                        if names[i] != signal.ANNOTATIONS:
                            out.append((i, every[at : at + n].astype(np.int64)))
                        at += n
                    yield pa.RecordBatch.from_arrays([pa.array([record] * len(out), pa.int64()), pa.array([i for i, _ in out], pa.int32()), pa.array([v for _, v in out], pa.list_(pa.int64()))], names=["record", "signal", "codes"])

        return self._raw().mapInArrow(split, "record long, signal int, codes array<long>")

    def values(self) -> DataFrame:
        """(record, signal, place, code, physical): every code with what the header's scales make of it."""
        ends = [tuple(map(float, s[3:7])) for s in self.signals]
        scales = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(e, ("pmin", "pmax", "dmin", "dmax"), strict=True))) for e in ends))
        rows = self.codes().select("record", "signal", F.posexplode("codes").alias("place", "code")).withColumn("_s", F.get(scales, F.col("signal")))
        return rows.select("record", "signal", "place", "code", signal.restored(F.col("code").cast("double"), *(F.col(f"_s.{n}") for n in ("pmin", "pmax", "dmin", "dmax"))).alias("physical"))

    def annotations(self) -> DataFrame:
        """(record, ordinal, onset, text); the first of a record is its own time, with an empty text."""
        points, names = self.points, [s[0] for s in self.signals]
        start = 2 * sum(n for n, name in zip(points, names, strict=True) if name != signal.ANNOTATIONS)

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("record", pa.int64()), ("ordinal", pa.int32()), ("onset", pa.string()), ("text", pa.string())])
            for batch in batches:
                rows = []
                for record, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for i, entry in enumerate(x for x in payload[start:].split(b"\0") if x):
                        onset, text = entry.decode("utf-8").split("\x14")[:2]
                        rows.append({"record": record, "ordinal": i, "onset": onset, "text": text})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        return self._raw().mapInArrow(split, "record long, ordinal int, onset string, text string")


def differences(recording: Recording, path: str, p: EdfPlan, kinds: list[signal.Signal]) -> DataFrame:
    """(record, signal, place, code, source): codes of a file, read with its own header's scales, that differ from the source's
    count by more than half a step, or at all where codes are whole steps, and what only one of them has. An independent way to ``verify``: all rows of both sides
    meet by record, signal and place; disconnected channels have no source and are left out."""
    file = EdfFile.open(recording.spark, path)
    place = {c: i for i, c in enumerate(p.channels)}
    live = [i for c, i in place.items() if not recording.header.shorted[c]]
    grid = p.grid

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            channel, sample, value = (batch.column(i).to_numpy() for i in range(3))
            found = [grid.place(int(s) - p.start) for s in sample]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([place[c] for c in channel.tolist()], pa.int32()), pa.array([o for _, o in found], pa.int32()), pa.array(value)], names=["record", "signal", "place", "source"])

    source = recording.samples(p.start, p.stop, list(p.channels)).select("channel", "sample", "value").mapInArrow(placed, "record long, signal int, place int, source long")
    scale = F.array(*(F.lit(float(UV_PER_COUNT if c < SIGNAL_CHANNELS else 1.0)) for c in p.channels))
    half = F.array(*(F.lit(float(k.half_step)) for k in kinds))
    steps = F.array(*(F.struct(*(F.lit(x).cast("long").alias(n) for x, n in zip((*(k.steps or (None, None)), k.digital[0]), ("low", "size", "dmin"), strict=True))) for k in kinds))
    both = file.values().where(F.col("signal").isin(live)).join(source, ["record", "signal", "place"], "full").withColumn("_k", F.get(steps, F.col("signal")))
    whole = F.abs((F.col("code") - F.col("_k.dmin")) * F.col("_k.size") + F.col("_k.low") - F.col("source")).cast("double")
    apart = F.coalesce(whole, F.abs(F.col("physical") - F.col("source") * F.get(scale, F.col("signal"))))
    return both.where(apart.isNull() | (apart > F.get(half, F.col("signal")) * (1 + 1e-9))).select("record", "signal", "place", "code", "source")
