"""EDF+ files as a Spark data source, to read and to write.

    register(spark)
    spark.read.format("edf").option("first", 10).option("stop", 20).option("signals", "0,3").load(uri)
    records.write.format("edf").option("header", header).mode("append").save(uri)

Reading takes one file or a folder of parts. Rows, by the option ``rows``: ``values`` (record, signal, place, code, physical),
the default, ``codes`` (record, signal, codes), ``annotations`` (record, ordinal, onset, text) or ``records`` (record, payload).
A task reads a run of records of about ``SPLIT_BYTES``. Records outside [first, stop) aren't read, and other signals than those
named aren't turned into rows. With the option ``filters`` "true", conditions on record and signal that Spark pushes do the
same, and all others are left to Spark; see ``datasource`` for why that isn't the default. No column is ever null.

Writing takes rows (record, payload) in any order, and the header as text, which says how many records there are and how long
they are. By the option ``layout``, each task writes runs of consecutive records as files of their own (``parts``, on any Arrow
file system), or its records at their places in one file (``file``, where tasks share a mounted file system). Nothing has the
file's name until all tasks are done: then the driver, which sees only runs and counts, checks that each record is there once,
and publishes the file by a link or the folder by its manifest, never over something else. If a task or that step fails, all
that this write made is deleted, also by lost attempts. Where a taken name can't be refused by the file system itself (others
than local ones), it's looked for just before.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import suppress
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from ..errors import DataIntegrityError
from ..functions import signal
from ..plans.edf import EdfPlan, plan
from . import datasource, edf
from .edf_store import MANIFEST, Head, Stored, located, record_batch
from .recording import Recording

NAME = "edf"
SPLIT_BYTES = 16 << 20
#: Name of the manifest of a folder that isn't verified yet.
UNVERIFIED = "_unverified.json"
SCHEMAS = {
    "values": "record long, signal int, place int, code long, physical double",
    "codes": "record long, signal int, codes array<long>",
    "annotations": "record long, ordinal int, onset string, text string",
    "records": edf.RECORDS,
}


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    datasource.register(spark, EdfSource)


def rows_of(options: dict[str, str]) -> str:
    rows = options.get("rows", "values")
    if rows not in SCHEMAS:
        raise ValueError(f"rows must be one of {', '.join(SCHEMAS)}")
    return rows


@dataclass(frozen=True)
class Chosen:
    """Records [first, stop), open if None, and signals, all if None."""

    first: int = 0
    stop: int | None = None
    signals: frozenset[int] | None = None

    def narrowed(self, condition: Filter, columns: list[str]) -> Chosen | None:
        """With a condition, or None if it isn't one that this source evaluates."""
        column, value = ".".join(getattr(condition, "attribute", ())), getattr(condition, "value", None)
        if isinstance(condition, IsNotNull) and column in columns:
            return self
        if column == "signal" and column in columns and isinstance(condition, (EqualTo, In)):
            named = value if isinstance(condition, In) else (value,)
            if all(type(v) is int for v in named):
                return replace(self, signals=frozenset(named) & (self.signals if self.signals is not None else frozenset(named)))
        if column != "record" or type(value) is not int:
            return None
        first, stop = {EqualTo: (value, value + 1), GreaterThan: (value + 1, None), GreaterThanOrEqual: (value, None), LessThan: (None, value), LessThanOrEqual: (None, value + 1)}.get(type(condition), (None, None))
        if first is None and stop is None:
            return None
        stops = [s for s in (self.stop, stop) if s is not None]
        return replace(self, first=max(self.first, first or 0), stop=min(stops) if stops else None)


@dataclass
class Run(InputPartition):
    first: int
    count: int


class EdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.rows, self.manifest = options["path"], rows_of(options), options.get("manifest", MANIFEST)
        signals = frozenset(map(int, options["signals"].split(","))) if "signals" in options else None
        self.chosen = Chosen(max(0, int(options.get("first", 0))), int(options["stop"]) if "stop" in options else None, signals)
        self.columns, self.stored = [c.split()[0] for c in SCHEMAS[self.rows].split(", ")], None

    def partitions(self) -> Sequence[InputPartition]:
        self.stored = Stored.open(self.uri, self.manifest)
        head, first = self.stored.head, self.chosen.first
        stop = head.records if self.chosen.stop is None else min(head.records, self.chosen.stop)
        per = max(1, SPLIT_BYTES // max(1, head.record_bytes))
        return [Run(at, min(per, stop - at)) for at in range(first, stop, per)] or [Run(0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        stored = self.stored or Stored.open(self.uri, self.manifest)
        width, give = stored.head.record_bytes, {"values": values_of, "codes": codes_of, "annotations": annotations_of, "records": lambda head, first, data, _: record_batch(first, data, head.record_bytes)}[self.rows]
        step = max(1, (4 << 20) // max(1, width))
        with stored.reader() as read:
            for at in range(partition.first, partition.first + partition.count, step):
                n = min(step, partition.first + partition.count - at)
                yield give(stored.head, at, read(at, n), self.chosen.signals)


class FilteredReader(EdfReader):
    """For loads that are used in one query only."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            narrowed = self.chosen.narrowed(condition, self.columns)
            if narrowed is None:
                yield condition
            else:
                self.chosen = narrowed


def live(head: Head, wanted: frozenset[int] | None) -> Iterator[tuple[int, int, int]]:
    """(signal, where its codes begin in a record, how many) of the ordinary signals that are wanted."""
    at = 0
    for i, n in enumerate(head.points):
        if head.signals[i][0] != signal.ANNOTATIONS and (wanted is None or i in wanted):
            yield i, at, n
        at += n


def codes_of(head: Head, first: int, data: bytes, wanted: frozenset[int] | None) -> pa.RecordBatch:
    every = np.frombuffer(data, "<i2").reshape(-1, head.record_bytes // 2)
    parts = list(live(head, wanted))
    rows = [(first + r, i, own[at : at + n].astype(np.int64)) for r, own in enumerate(every) for i, at, n in parts]
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=["record", "signal", "codes"])


def values_of(head: Head, first: int, data: bytes, wanted: frozenset[int] | None) -> pa.RecordBatch:
    every = np.frombuffer(data, "<i2").reshape(-1, head.record_bytes // 2)
    found = [[np.zeros(0, t)] for t in (np.int64, np.int32, np.int32, np.int64, np.float64)]
    for i, at, n in live(head, wanted):
        code = every[:, at : at + n].astype(np.int64).ravel()
        pmin, pmax, dmin, dmax = map(float, head.signals[i][3:7])
        own = (np.repeat(np.arange(first, first + len(every)), n), np.full(code.size, i, np.int32), np.tile(np.arange(n, dtype=np.int32), len(every)), code, (code - dmin) * ((pmax - pmin) / (dmax - dmin)) + pmin)
        for column, part in zip(found, own, strict=True):
            column.append(part)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], names=["record", "signal", "place", "code", "physical"])


def annotations_of(head: Head, first: int, data: bytes, _: object) -> pa.RecordBatch:
    """Of every annotation signal; a text of several annotations at one onset is several rows."""
    rows, at, spans = [], 0, []
    for s, n in zip(head.signals, head.points, strict=True):
        if s[0] == signal.ANNOTATIONS:
            spans.append((2 * at, 2 * (at + n)))
        at += n
    for r in range(len(data) // head.record_bytes if head.record_bytes else 0):
        ordinal = 0
        for a, b in spans:
            for entry in filter(None, data[r * head.record_bytes + a : r * head.record_bytes + b].split(b"\0")):
                onset, *texts = entry.decode("utf-8").split("\x14")
                for text in texts[:-1] or [""]:
                    rows.append({"record": first + r, "ordinal": ordinal, "onset": onset.split("\x15")[0], "text": text})
                    ordinal += 1
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("record", pa.int64()), ("ordinal", pa.int32()), ("onset", pa.string()), ("text", pa.string())]))


@dataclass
class Written(WriterCommitMessage):
    """(first record, records, name of the part, empty for one file) of each run that a task wrote."""

    runs: list[tuple[int, int, str]]


def remove(fs: pafs.FileSystem, path: str) -> None:
    with suppress(FileNotFoundError):
        fs.delete_file(path)


def name_is_free(fs: pafs.FileSystem, path: str) -> None:
    if fs.get_file_info(path).type != pafs.FileType.NotFound or isinstance(fs, pafs.LocalFileSystem) and os.path.lexists(path):
        raise FileExistsError(path)


def give_name(fs: pafs.FileSystem, made: str, path: str) -> None:
    """Let a finished file have its name, which must be free."""
    if isinstance(fs, pafs.LocalFileSystem):
        edf.publish(made, path)
        os.unlink(made)
    else:
        name_is_free(fs, path)
        fs.move(made, path)


class EdfWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool):
        if overwrite:
            raise ValueError("an existing file is never replaced: use the mode append and a free name")
        if columns != ["record", "payload"]:
            raise ValueError("rows must be (record, payload)")
        self.uri, self.layout, self.manifest = options["path"], options.get("layout", "parts"), options.get("manifest", MANIFEST)
        if self.layout not in ("parts", "file"):
            raise ValueError("layout must be parts or file")
        self.head, self.token = Head(options["header"].encode("ascii")), uuid.uuid4().hex
        self.probe()

    def probe(self) -> None:
        """Refuse a taken name, and a place where the file couldn't be made or published, before any task runs.

        What tasks write into is made here: a task that still runs when the write is aborted finds it gone and makes no new one.
        """
        fs, path = located(self.uri)
        name_is_free(fs, path)
        folder, mounted = os.path.dirname(path), isinstance(fs, pafs.LocalFileSystem)
        if mounted:
            edf.probe(folder, len(self.head.data) + self.head.records * self.head.record_bytes)
        elif self.layout == "file":
            raise ValueError("this file system takes parts only")
        else:
            with fs.open_output_stream(f"{folder}/.publish-{self.token}"):
                pass
            fs.delete_file(f"{folder}/.publish-{self.token}")
        if self.layout == "parts":
            os.mkdir(path) if mounted else fs.create_dir(path)
        else:
            with open(f"{path}.partial-{self.token}", "xb") as f:
                f.truncate(len(self.head.data) + self.head.records * self.head.record_bytes)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        put = self.into_place if self.layout == "file" else self.into_parts
        rows = ((record, payload) for batch in iterator for record, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        return Written(put(self.checked(rows)))

    def checked(self, rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        for record, payload in rows:
            if record is None or payload is None or not 0 <= record < self.head.records or len(payload) != self.head.record_bytes:
                raise DataIntegrityError(f"record {record} doesn't fit the header")
            yield record, payload

    def into_place(self, rows: Iterator[tuple[int, bytes]]) -> list[tuple[int, int, str]]:
        _, path = located(self.uri)
        runs: list[tuple[int, int, str]] = []
        with open(f"{path}.partial-{self.token}", "r+b") as f:
            for record, payload in rows:
                f.seek(len(self.head.data) + record * self.head.record_bytes)
                f.write(payload)
                if runs and record == sum(runs[-1][:2]):
                    runs[-1] = (runs[-1][0], runs[-1][1] + 1, "")
                else:
                    runs.append((record, 1, ""))
            f.flush()
            os.fsync(f.fileno())
        return runs

    def into_parts(self, rows: Iterator[tuple[int, bytes]]) -> list[tuple[int, int, str]]:
        fs, path = located(self.uri)
        attempt, runs, out = TaskContext.get().taskAttemptId(), [], None
        try:
            for record, payload in rows:
                if out is None or record != sum(runs[-1][:2]):
                    if out:
                        out.close()
                    runs.append((record, 0, f"records-{record:015d}-{attempt}-{len(runs)}.{self.token}"))
                    out = fs.open_output_stream(f"{path}/{runs[-1][2]}")
                out.write(payload)
                runs[-1] = (runs[-1][0], runs[-1][1] + 1, runs[-1][2])
        finally:
            if out:
                out.close()
        return runs

    def commit(self, messages: list[Written | None]) -> None:
        runs, at = sorted(r for m in messages if m for r in m.runs), 0
        for first, count, _ in runs:
            if first != at:
                raise DataIntegrityError(f"record {min(first, at)} was written {'twice' if first < at else 'by no task'}")
            at += count
        if at != self.head.records:
            raise DataIntegrityError(f"record {at} was written by no task")
        fs, path = located(self.uri)
        if self.layout == "file":
            partial = f"{path}.partial-{self.token}"
            with open(partial, "r+b") as f:
                f.write(self.head.data)
                f.flush()
                os.fsync(f.fileno())
            give_name(fs, partial, path)
            return
        named = {name for *_, name in runs}
        for name in self.mine(fs, path):
            if name not in named:
                remove(fs, f"{path}/{name}")
        made = f"{path}/manifest.{self.token}"
        with fs.open_output_stream(made) as f:
            f.write(json.dumps({"header": self.head.data.decode("ascii"), "parts": [[name, count] for _, count, name in runs]}).encode())
        give_name(fs, made, f"{path}/{self.manifest}")

    def mine(self, fs: pafs.FileSystem, path: str) -> list[str]:
        return [i.base_name for i in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if i.base_name.endswith(f".{self.token}")]

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = located(self.uri)
        if self.layout == "file":
            remove(fs, f"{path}.partial-{self.token}")
            return
        for _ in range(10):  # a task that still runs may have begun a part meanwhile
            for name in self.mine(fs, path):
                remove(fs, f"{path}/{name}")
            if fs.get_file_info(path).type != pafs.FileType.Directory or fs.get_file_info(pafs.FileSelector(path)):
                return
            with suppress(OSError):
                os.rmdir(path) if isinstance(fs, pafs.LocalFileSystem) else fs.delete_dir(path)


class EdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMAS[rows_of(self.options)]

    def reader(self, schema) -> DataSourceReader:
        return (FilteredReader if self.options.get("filters") == "true" else EdfReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return EdfWriter(dict(self.options), schema.fieldNames(), overwrite)


def save(records: DataFrame, uri: str, header: bytes, **options: str) -> None:
    """Write (record, payload) rows, brought together in runs of about ``SPLIT_BYTES``, so that parts are few."""
    register(records.sparkSession)
    head = Head(header)
    per = max(1, SPLIT_BYTES // max(1, head.record_bytes))
    run = F.floor(F.col("record") / per)
    placed = records.repartition(max(1, -(-head.records // per)), run).sortWithinPartitions("record")
    placed.write.format(NAME).options(header=header.decode("ascii"), **options).mode("append").save(uri)


def export(recording: Recording, uri: str, *, max_error: float = 0.5, **options) -> EdfPlan:
    """Write a recording as a folder of parts on any Arrow file system, compare all of it with the source, and only then publish it.

    ``options`` are those of the plan. Until it's verified its manifest has another name, by which no reader finds it; if anything
    fails, or the source changed meanwhile, the folder goes. A folder that is there already is left alone.
    """
    fs, path = located(uri)
    name_is_free(fs, path)
    before = edf._signatures(recording)
    recording = recording.indexed()
    p = plan(recording, **options)
    kinds = edf.kinds_of(recording, p, max_error)
    save(edf.encoded(recording, p, kinds), uri, edf.header(p, kinds), manifest=UNVERIFIED)
    try:
        edf.verify(recording, uri, p, kinds, UNVERIFIED)
        if edf._signatures(recording) != before:
            raise DataIntegrityError("the recording changed while it was exported")
        give_name(fs, f"{path}/{UNVERIFIED}", f"{path}/{MANIFEST}")
    except BaseException:
        fs.delete_dir(path)
        raise
    return p
