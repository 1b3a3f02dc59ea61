"""A recording as DataFrames: segments, packets, channels, samples, notes and clock anchors.

Metadata files are small and parsed where they are listed; packet indexes are parsed by tasks, one segment each. Waveform
bytes are read only by ``blocks``, whose tasks take runs of packets. Nothing but counts comes to the driver from there.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataIntegrityError, UnsupportedFormatError
from ..functions import notes as note_functions
from ..limits import ReadLimits, check, index
from ..session import materialise, ship_package
from . import layout
from .packets import decode_run

SEGMENTS = "segment_index int, segment_name string, start_stamp long, end_stamp long, sample_number long, stored_samples long, erd string, etc string"
PACKETS = "segment_index int, packet_index int, byte_offset long, byte_end long, sample_stamp long, sample_number long, sample_span int, erd string, file_size long, modified long"
FAULTS = "segment_index int, packet_index int, fault string"
BLOCKS = "segment_index int, packet_index int, channel int, start_sample long, values array<long>"
ANCHORS = "stamp long, ticks long"
#: Packets that one task takes, at least, and that are decoded together; bytes of these.
RUN_PACKETS, RUN_BYTES = 64, 4 << 20


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def regular(fs: pafs.FileSystem, path: str) -> pafs.FileInfo:
    """A file's size and time; on a local file system, links are refused, as their target may lie anywhere."""
    if isinstance(fs, pafs.LocalFileSystem) and os.path.islink(path):
        raise DataIntegrityError(f"{path} is a symbolic link")
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type != pafs.FileType.File:
        raise DataIntegrityError(f"{path} isn't a regular file")
    return info


def read_bytes(fs: pafs.FileSystem, path: str, most: int, what: str) -> bytes:
    """A small file, whole; its size is checked first, no more than that is read, and it must stay as it is."""
    before = regular(fs, path)
    check(before.size, most, what)
    with fs.open_input_file(path) as f:
        data = f.read(before.size)
    after = fs.get_file_info(path)
    if len(data) != before.size or (after.size, after.mtime_ns) != (before.size, before.mtime_ns):
        raise DataIntegrityError(f"{what} changed while it was read")
    return data


class Directory:
    """A folder's files by case-folded name; a name that several files share can't be looked up."""

    def __init__(self, uri: str, limits: ReadLimits):
        self.fs, self.path = filesystem(uri)
        if any(part.casefold() == "decimated" for part in self.path.split("/")):
            raise UnsupportedFormatError("decimated recordings aren't supported")
        entries = self.fs.get_file_info(pafs.FileSelector(self.path))
        check(len(entries), limits.max_directory_entries, "directory entries")
        self._names: dict[str, list[pafs.FileInfo]] = {}
        for entry in entries:
            self._names.setdefault(entry.base_name.casefold(), []).append(entry)

    def find(self, name: str) -> pafs.FileInfo | None:
        found = self._names.get(name.casefold(), [])
        if len(found) > 1:
            raise DataIntegrityError(f"several files are named {name} but for case")
        if found and found[0].type != pafs.FileType.File:
            raise DataIntegrityError(f"{name} isn't a regular file")
        return found[0] if found else None

    def require(self, name: str) -> pafs.FileInfo:
        found = self.find(name)
        if found is None:
            raise FileNotFoundError(f"{self.path}/{name}")
        return found

    def tables(self) -> list[str]:
        return sorted(n[0].base_name for n in self._names.values() if n[0].base_name.casefold().endswith(".stc") and n[0].type == pafs.FileType.File)


def resolve(uri: str, limits: ReadLimits) -> tuple[Directory, str]:
    """The folder and segment table behind a folder, a table, a data file or a selector file."""
    head, _, last = uri.rstrip("/").rpartition("/")
    stem, dot, kind = last.rpartition(".")
    kind = kind.casefold() if dot else ""
    folder = Directory(head if kind in ("stc", "eeg", "erd") else uri, limits)
    if kind == "stc":
        return folder, folder.require(last).base_name
    if kind == "eeg":
        return folder, folder.require(f"{stem}.stc").base_name
    tables = folder.tables()
    if not tables:
        raise FileNotFoundError(f"no segment table in {folder.path}")
    if len(tables) > 1:
        raise DataIntegrityError(f"several segment tables in {folder.path}")
    return folder, tables[0]


def described(uri: str, limits: ReadLimits, channels: int | None) -> tuple:
    """The fields of a recording but for its session: its metadata is read and checked here."""
    folder, name = resolve(uri, limits)
    table = layout.parse_segments(read_bytes(folder.fs, folder.require(name).path, limits.max_metadata_bytes, "the segment table"))
    check(len(table), limits.max_segments, "segments")
    faults = layout.segment_faults(table)
    if faults:
        raise DataIntegrityError("; ".join(faults))
    files = [(folder.require(f"{s[0]}.erd"), folder.require(f"{s[0]}.etc")) for s in table]
    if uri.casefold().endswith(".erd") and uri.rsplit("/", 1)[1].casefold() not in {e.base_name.casefold() for e, _ in files}:
        raise DataIntegrityError("the data file belongs to no segment of the table")
    first = next((e for e, _ in files if e.size >= layout.ERD_HEADER), None)
    if first is None:
        raise DataIntegrityError("no data file has a whole header")
    regular(folder.fs, first.path)
    with folder.fs.open_input_file(first.path) as f:
        header = layout.parse_header(f.read(layout.ERD_HEADER))
    unlike = layout.layout_faults(header, channels)
    if unlike:
        raise UnsupportedFormatError("layout not supported: " + ", ".join(unlike))
    stem = name[:-4]
    notes = folder.find(f"{stem}.ent") or folder.find(f"{stem}.ent.old")
    clock = folder.find(f"{stem}.snc")
    base = uri if not uri.casefold().endswith((".stc", ".eeg", ".erd")) else uri.rpartition("/")[0]
    where = lambda info: None if info is None else f"{base.rstrip('/')}/{info.base_name}"
    return (base, limits, header, table, [(where(e), where(t)) for e, t in files], where(notes), where(clock))


@dataclass(frozen=True)
class Recording:
    """A static recording. ``open`` checks its metadata; waveforms are decoded lazily by the DataFrames."""

    spark: SparkSession
    uri: str
    limits: ReadLimits
    header: layout.Header
    table: list[tuple[str, int, int, int, int]]
    files: list[tuple[str, str]]
    notes_path: str | None
    clock_path: str | None

    @staticmethod
    def open(spark: SparkSession, uri: str, *, limits: ReadLimits | None = None, channels: int | None = layout.RECORDED_CHANNELS) -> Recording:
        ship_package(spark)
        return Recording(spark, *described(uri, limits or ReadLimits(), channels))

    @property
    def origin(self) -> int:
        return self.table[0][1]

    @property
    def n_samples(self) -> int:
        """Logical samples, gaps included."""
        return self.table[-1][2] - self.origin + 1

    def info(self) -> DataFrame:
        h = self.header
        row = (h.sample_rate, self.n_samples, h.n_channels, min(h.n_channels, layout.SIGNAL_CHANNELS), len(self.table), self.origin, self.table[-1][2], h.file_schema, h.base_schema, h.headbox[0], h.delta_bits, h.discard_bits, self.n_samples / h.sample_rate)
        return self.spark.createDataFrame([row], "sample_rate double, n_samples long, n_recorded_channels int, n_signal_channels int, segment_count int, start_stamp long, end_stamp long, file_schema int, base_schema int, headbox_type int, delta_bits int, discard_bits int, duration_seconds double")

    def segments(self) -> DataFrame:
        return self.spark.createDataFrame([(i, *s, *f) for i, (s, f) in enumerate(zip(self.table, self.files, strict=True))], SEGMENTS)

    def _indexed(self, give, schema: str) -> DataFrame:
        """The rows that ``give`` makes of each segment's row, index entries, packet ends and data file; a task per segment."""
        limits, header = self.limits, self.header

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    entries, ends, data = index_of(row, limits, header)
                    yield pa.RecordBatch.from_arrays(give(row, entries, ends, data), names=[f.split()[0] for f in schema.split(", ")])

        return self.segments().repartition(len(self.table), "segment_index").mapInArrow(parse, schema)

    @cached_property
    def _packets(self) -> DataFrame:
        limits, header = self.limits, self.header

        def give(row: dict, entries: np.ndarray, ends: np.ndarray, data: pafs.FileInfo) -> list[pa.Array]:
            refuse(row, entries, ends, data, limits, header)
            n = len(entries)
            return [
                pa.array([row["segment_index"]] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), pa.array(entries["offset"].astype(np.int64)), pa.array(ends.astype(np.int64)),
                *(pa.array(entries[c].astype(np.int64)) for c in ("stamp", "number")), pa.array(entries["span"].astype(np.int32)),
                pa.array([row["erd"]] * n, pa.string()), pa.array([data.size] * n, pa.int64()), pa.array([data.mtime_ns] * n, pa.int64()),
            ]

        return self._indexed(give, PACKETS)

    def packets(self) -> DataFrame:
        """The packet index of all segments, refused by whoever reads it if a segment's entries contradict their file, the
        segment or each other. ``byte_end`` is the next packet's offset or the file's size."""
        return self._packets

    def packet_faults(self) -> DataFrame:
        """(segment_index, packet_index, fault) of entries that contradict their file, their segment or each other."""
        header = self.header

        def give(row: dict, entries: np.ndarray, ends: np.ndarray, data: pafs.FileInfo) -> list[pa.Array]:
            found = [(i, name) for name, bad in layout.index_faults(entries, ends, data.size, header, row["start_stamp"], row["end_stamp"]).items() for i in np.flatnonzero(bad).tolist()]
            return [pa.array([row["segment_index"]] * len(found), pa.int32()), pa.array([i for i, _ in found], pa.int32()), pa.array([name for _, name in found], pa.string())]

        return self._indexed(give, FAULTS)

    def select(self, channels: object = None) -> list[int]:
        """Channel numbers of a selection: None (the signals), a number, a name, or a sequence of them in its order."""
        h = self.header
        if channels is None:
            return list(range(min(h.n_channels, layout.SIGNAL_CHANNELS)))
        wanted = list(channels) if isinstance(channels, (list, tuple, range, np.ndarray)) else [channels]
        names = [r["name"] for r in self.channels().orderBy("channel").select("name").collect()] if any(isinstance(c, str) for c in wanted) else []
        out = []
        for c in wanted:
            if isinstance(c, str):
                if names.count(c) != 1:
                    raise ValueError(f"{'ambiguous' if c in names else 'unknown'} channel name {c!r}")
                out.append(names.index(c))
                continue
            i = index(c, "a channel")
            if not 0 <= i < h.n_channels:
                raise IndexError(f"channel {i} of {h.n_channels}")
            out.append(i)
        check(len(out), self.limits.max_selected_channels, "selected channels")
        return out

    def channels(self) -> DataFrame:
        """One row per channel with its name from the notes, or a default."""
        h = self.header
        given = note_functions.montage(self.notes().select("text", "value").collect(), self.limits) if self.notes_path else []
        given = note_functions.fit_montage(given, h.n_channels)
        names = note_functions.complete_names(given, h.n_channels)
        rows = [(i, names[i], h.physical[i], h.shorted[i], i < layout.SIGNAL_CHANNELS, "uV" if i < layout.SIGNAL_CHANNELS else None, layout.UV_PER_COUNT if i < layout.SIGNAL_CHANNELS else None, i < len(given) and given[i] is not None) for i in range(h.n_channels)]
        return self.spark.createDataFrame(rows, "channel int, name string, physical_index int, shorted boolean, is_signal boolean, unit string, scale_uv_per_count double, name_resolved boolean")

    def scan_size(self, start: int, stop: int, channels: list[int] | None = None) -> int:
        """The most values that a read of a window can decode, from the segment table alone: of each segment as many samples
        as it stores or the window has of it, of each channel that isn't shorted."""
        live = sum(not self.header.shorted[c] for c in (range(self.header.n_channels) if channels is None else set(channels)))
        inside = ((min(last - self.origin + 1, stop) - max(first - self.origin, start), stored) for _, first, last, _, stored in self.table)
        return live * sum(max(0, min(n, stored)) for n, stored in inside)

    def stamp_of(self, sample: Column) -> Column:
        """The stamp of a sample; the exclusive end has one, too. Other samples raise."""
        return F.when(sample.between(0, self.n_samples), sample + self.origin).when(sample.isNotNull(), F.raise_error(F.lit("a sample lies outside the recording")))

    def sample_of(self, stamp: Column) -> Column:
        """The sample of a stamp, up to that of the exclusive end. Other stamps raise."""
        sample = stamp - self.origin
        return F.when(sample.between(0, self.n_samples), sample).when(stamp.isNotNull(), F.raise_error(F.lit("a stamp lies outside the recording")))

    def anchor_span(self) -> DataFrame:
        """(first_anchor_sample, last_anchor_sample), one row."""
        return self.anchors().agg((F.min("stamp") - self.origin).alias("first_anchor_sample"), (F.max("stamp") - self.origin).alias("last_anchor_sample"))

    def window(self, start: int, stop: int | None) -> tuple[int, int]:
        start = index(start, "start")
        stop = self.n_samples if stop is None else index(stop, "stop")
        if not 0 <= start <= stop <= self.n_samples:
            raise IndexError(f"samples {start} to {stop} of {self.n_samples}")
        return start, stop

    def decoded(self, give: Callable[..., Iterator[pa.RecordBatch]], schema: str, start: int = 0, stop: int | None = None, channels: list[int] | None = None) -> DataFrame:
        """What ``give`` makes of runs of neighbouring packets, in the task that decodes them.

        It gets the packets' rows, their first samples, the channels that aren't shorted, in ascending order, and for each
        packet an array of counts (channels, samples), clipped to the samples asked for.
        """
        start, stop = self.window(start, stop)
        check(self.scan_size(start, stop, channels), self.limits.max_scan_values, "values of a read")
        h, origin, wanted = self.header, self.origin, None if channels is None else sorted(set(channels))
        shorted = np.array(h.shorted)
        first = F.col("sample_stamp") - origin
        touched = self.packets().where((first < stop) & (first + F.col("sample_span") > start))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in decoded_runs(row_runs(row for batch in batches for row in batch.to_pylist()), shorted, origin, start, stop, wanted):
                yield from give(*found)

        run_of = F.floor(F.col("packet_index") / RUN_PACKETS)
        dealt = touched.repartition(self.spark.sparkContext.defaultParallelism, "segment_index", run_of)
        return dealt.sortWithinPartitions("segment_index", "packet_index").mapInArrow(run, schema)

    def blocks(self, start: int = 0, stop: int | None = None, channels: list[int] | None = None) -> DataFrame:
        """Stored counts as one row per packet and channel that isn't shorted, clipped to the samples asked for."""

        def give(rows: list[dict], starts: list[int], own: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            n = len(own)
            sizes = np.repeat([v.shape[1] for v in values], n)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate([v.ravel() for v in values])))
            repeated = lambda x, kind: pa.array(np.repeat(np.array(x), n).astype(kind))
            yield pa.RecordBatch.from_arrays([repeated([r["segment_index"] for r in rows], "i4"), repeated([r["packet_index"] for r in rows], "i4"), pa.array(np.tile(own, len(rows)).astype(np.int32)), repeated(starts, "i8"), lists], names=["segment_index", "packet_index", "channel", "start_sample", "values"])

        return self.decoded(give, BLOCKS, start, stop, channels)

    def ranges(self, start: int = 0, stop: int | None = None, channels: list[int] | None = None) -> DataFrame:
        """(channel, low, high): least and largest stored count of each channel; a task gives one row a run and channel."""

        def give(rows: list[dict], starts: list[int], own: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            filled = [v for v in values if v.shape[1]]
            if filled:
                low, high = np.min([v.min(axis=1) for v in filled], axis=0), np.max([v.max(axis=1) for v in filled], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(low), pa.array(high)], names=["channel", "low", "high"])

        return self.decoded(give, "channel int, low long, high long", start, stop, channels).groupBy("channel").agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def samples(self, start: int = 0, stop: int | None = None, channels: list[int] | None = None) -> DataFrame:
        """(sample, stamp, channel, value) of stored samples."""
        rows = self.blocks(start, stop, channels).select("channel", "start_sample", F.posexplode("values").alias("i", "value"))
        sample = F.col("start_sample") + F.col("i")
        return rows.select(sample.alias("sample"), (sample + self.origin).alias("stamp"), "channel", "value")

    def matrix(self, start: int, stop: int, channels: object = None, units: str = "uV") -> np.ndarray:
        """A small dense window as float64 (selection, samples); gaps and shorted channels are NaN."""
        start, stop = self.window(start, stop)
        chosen = self.select(channels)
        if units not in ("uV", "digital"):
            raise ValueError("units must be 'uV' or 'digital'")
        if units == "uV" and any(c >= layout.SIGNAL_CHANNELS for c in chosen):
            raise UnsupportedFormatError("only signal channels have a unit of uV")
        from ..limits import check_output

        check_output(len(chosen), stop - start, self.limits)
        out = np.full((self.header.n_channels, stop - start), np.nan)
        for batch in self.blocks(start, stop, chosen).select("channel", "start_sample", "values").toArrow().to_batches():  # as small as the window
            lists = batch.column(2)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for channel, at, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends, ends[1:], strict=False):
                out[channel, at - start : at - start + b - a] = flat[a:b]
        return out[chosen] * (layout.UV_PER_COUNT if units == "uV" else 1.0)

    def chunks(self, start: int = 0, stop: int | None = None, *, chunk_samples: int = 20_480, channels: object = None, units: str = "uV") -> Iterator[np.ndarray]:
        """Dense windows of ``chunk_samples`` samples, the last one shorter.

        The index is parsed once. As many chunks as a dense read may have are read by one job, and the next ones while the
        caller takes these, so two such reads are held at a time.
        """
        start, stop = self.window(start, stop)
        if index(chunk_samples, "chunk_samples") < 1:
            raise ValueError("chunk_samples must be positive")
        width = max(1, len(self.select(channels))) * 8
        most = min(self.limits.max_read_samples, self.limits.max_read_bytes // width)
        step = max(1, most // chunk_samples) * chunk_samples
        windows = [(a, min(stop, a + step)) for a in range(start, stop, step)]
        source = self.indexed() if len(windows) > 1 else self
        with ThreadPoolExecutor(1) as ahead:
            due = [ahead.submit(source.matrix, *w, channels, units) for w in windows[:1]]
            for following in [*windows[1:], None]:
                found = due.pop().result() if due else np.zeros((0, 0))
                if following:
                    due.append(ahead.submit(source.matrix, *following, channels, units))
                for a in range(0, found.shape[1], chunk_samples):
                    yield found[:, a : a + chunk_samples]

    def indexed(self) -> Recording:
        """The same with its packet index parsed and checked now, once, and written to the shared scratch folder."""
        other = replace(self)
        other.__dict__["_packets"] = materialise(self._packets, "packets")
        return other

    def notes(self) -> DataFrame:
        """(ordinal, note_type, length, previous_length, text, value) with the parsed value as JSON, null if it has none."""
        if self.notes_path is None:
            return self.spark.createDataFrame([], note_functions.NOTES)
        limits, path = self.limits, self.notes_path

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                fs, local = filesystem(path)
                rows = note_functions.parse_file(read_bytes(fs, local, limits.max_ent_bytes, "the notes"), limits)
                yield pa.RecordBatch.from_pylist(rows, schema=note_functions.ARROW)

        return self.spark.range(1).repartition(1).mapInArrow(parse, note_functions.NOTES)

    def events(self) -> DataFrame:
        """Notes whose stamp is an integer and whose text is a string, in order of stamp and then of the file.

        Nothing is cast: ``"6"`` and ``true`` are no stamps, 7 is no text, and a user that isn't a string is null.
        """
        value = F.parse_json("value")
        part = lambda path: F.try_variant_get(value, path, "variant")
        kind = lambda path: F.schema_of_variant(part(path))
        user = F.when(kind("$.Data.User") == "STRING", F.try_variant_get(value, "$.Data.User", "string"))
        rows = self.notes().where(F.col("value").startswith("{"))
        rows = rows.where(kind("$.Stamp").rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$") & (kind("$.Text") == "STRING") & F.get_json_object("value", "$.Stamp").rlike("^-?[0-9]+$"))
        rows = rows.select("ordinal", "note_type", F.try_variant_get(value, "$.Stamp", "long").alias("stamp"), F.try_variant_get(value, "$.Text", "string").alias("text"), user.alias("user")).where("stamp is not null")
        return rows.select("ordinal", "stamp", (F.col("stamp") - self.origin).alias("sample"), "text", "user", "note_type").orderBy("stamp", "ordinal")

    def anchors(self) -> DataFrame:
        """Clock anchors; the file's checks are made here."""
        if self.clock_path is None:
            raise FileNotFoundError("the recording has no clock file")
        fs, path = filesystem(self.clock_path)
        pairs = layout.parse_anchors(read_bytes(fs, path, self.limits.max_metadata_bytes, "the clock file"))
        check(len(pairs), self.limits.max_clock_anchors, "clock anchors")
        if any(b[0] <= a[0] or b[1] <= a[1] for a, b in zip(pairs, pairs[1:], strict=False)):
            raise DataIntegrityError("clock anchors don't increase")
        if any(not self.origin <= s <= self.table[-1][2] for s, _ in pairs):
            raise DataIntegrityError("a clock anchor lies outside the recording")
        if any(t > 2_650_467_743_999_999_999 for _, t in pairs):  # the last tick of the year 9999
            raise DataIntegrityError("a clock anchor lies outside the years that are supported")
        return self.spark.createDataFrame(pairs, ANCHORS)


def index_of(row: dict, limits: ReadLimits, header: layout.Header) -> tuple[np.ndarray, np.ndarray, pafs.FileInfo]:
    """A segment's index entries, where their packets end, and its data file, whose header must be the recording's."""
    fs, path = filesystem(row["etc"])
    _, erd = filesystem(row["erd"])
    data = regular(fs, erd)
    entries = layout.parse_packets(read_bytes(fs, path, limits.max_metadata_bytes, "a packet index"))
    check(len(entries), limits.max_packets_per_segment, "packets of a segment")
    if data.size >= layout.ERD_HEADER:
        with fs.open_input_file(erd) as f:
            own = layout.parse_header(f.read(layout.ERD_HEADER))
        if own != header:
            raise DataIntegrityError("sample rates of segments differ" if own.sample_rate != header.sample_rate else "headers of segments differ")
    if (now := fs.get_file_info(erd)).size != data.size or now.mtime_ns != data.mtime_ns:
        raise DataIntegrityError("a data file changed while it was indexed")
    offsets = entries["offset"].astype(np.int64)
    return entries, np.append(offsets[1:], data.size)[: len(entries)], data


def refuse(row: dict, entries: np.ndarray, ends: np.ndarray, data: pafs.FileInfo, limits: ReadLimits, header: layout.Header) -> None:
    """Raise if a segment's entries contradict their file, the segment or each other."""
    faults = {name: int(bad.sum()) for name, bad in layout.index_faults(entries, ends, data.size, header, row["start_stamp"], row["end_stamp"]).items() if bad.any()}
    if faults:
        raise DataIntegrityError("packet index: " + ", ".join(f"{name} ({n})" for name, n in sorted(faults.items())))
    if not len(entries) and data.size != layout.ERD_HEADER:
        raise DataIntegrityError("a data file has samples that no index entry names")
    if int(entries["span"].sum(dtype=np.int64)) != row["stored_samples"]:
        raise DataIntegrityError("a segment stores another number of samples than its table says")
    check(int((ends - entries["offset"]).max(initial=0)), limits.max_packet_bytes, "packet bytes")


def decoded_runs(runs: Iterator[list[dict]], shorted: np.ndarray, origin: int, start: int, stop: int, wanted: list[int] | None) -> Iterator[tuple[list[dict], list[int], np.ndarray, list[np.ndarray]]]:
    """For each run of packets of one file its rows, first samples, channels and counts (channels, samples) by packet."""
    active = np.flatnonzero(~shorted)
    keep = np.arange(len(active)) if wanted is None else np.flatnonzero(np.isin(active, wanted))
    for rows in runs:
        fs, path = filesystem(rows[0]["erd"])
        unchanged(fs, path, rows[0])
        parts = []
        with fs.open_input_file(path) as f:
            for row in rows:
                f.seek(row["byte_offset"])
                parts.append(f.read(row["byte_end"] - row["byte_offset"]))
        unchanged(fs, path, rows[0])
        places = [row["sample_stamp"] - origin for row in rows]
        stops = [min(row["sample_span"], stop - at) for row, at in zip(rows, places, strict=True)]
        found = decode_run(parts, [row["sample_span"] for row in rows], shorted, stops)
        if len(keep):
            skipped = [max(0, start - at) for at in places]
            yield rows, [at + a for at, a in zip(places, skipped, strict=True)], active[keep], [np.ascontiguousarray(v[a:, keep].T) for v, a in zip(found, skipped, strict=True)]


def row_runs(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """Up to ``RUN_PACKETS`` rows of one file at a time, and of no more than ``RUN_BYTES`` unless one has more."""
    run, size = [], 0
    for row in rows:
        more = row["byte_end"] - row["byte_offset"]
        if run and (row["erd"] != run[0]["erd"] or len(run) == RUN_PACKETS or size + more > RUN_BYTES):
            yield run
            run, size = [], 0
        run.append(row)
        size += more
    if run:
        yield run


def unchanged(fs: pafs.FileSystem, path: str, row: dict) -> None:
    now = regular(fs, path)
    if (now.size, now.mtime_ns) != (row["file_size"], row["modified"]):
        raise DataIntegrityError("a data file changed after it was indexed")


def in_window(sample: Column, start: int, stop: int) -> Column:
    return (sample >= start) & (sample < stop)
