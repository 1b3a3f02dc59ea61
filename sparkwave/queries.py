"""Queries of the recording engine over recordings that are made from ``events``, with their SQL.

The engine's input is a family of binary files, which the tables don't hold. So each query first encodes ``events`` with
the package's encoder, or takes a recording that this application has encoded before, and then runs on the decoded files;
the SQL states the same result over ``events``. Every event is a sample: on the first recording days are parted by gaps of
97 samples, with 31 samples missing in front and 20 at the end; on the second a gap of 250 follows every 1000 samples.
Channels are 100 times the value, the user, and ``k`` of the properties; a fourth one is shorted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import clock, exact, notes, signal
from .limits import ReadLimits
from .operators import coverage, ranges
from .plans.edf import plan
from .session import materialise, scratch_dir, ship_package
from .sources import datasource, edf, edf_source, layout, synth
from .sources.layout import UV_PER_COUNT, packet_byte_bounds
from .sources.recording import Recording, filesystem
from .streaming.chunks import stream_chunk_stats

RATE, ORIGIN, PACKET, SEGMENT, CHANNELS = 500.0, 1000, 64, 16_384, 4
LEAD, DAY_GAP, TRAIL = 31, 97, 20
RUN, RUN_GAP = 1000, 250
TICKS_0 = 133_485_408_000_000_000  # 2024-01-01 in ticks of 100 ns since 1601
TICKS_PER_SAMPLE = 20_000
ANCHOR_STEP, ANCHOR_FIRST, NOMINAL_SAMPLES = 1000, 200, 100
#: Larger recordings than the defaults allow are fine here.
LIMITS = ReadLimits(max_packets_per_segment=1 << 20, max_read_samples=1 << 40, max_read_bytes=1 << 50, max_scan_values=1 << 62, max_metadata_bytes=1 << 30, max_segments=1 << 22, max_directory_entries=1 << 24, max_clock_anchors=1 << 26)
WIDE, SLOTS = 276, 512
_made: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, day, c0, c1, c2) of all events."""
    events = table(spark, sf_dir, "events")
    first = F.broadcast(events.agg(F.min(F.to_date("ts")).alias("first")))
    k = F.get_json_object("props", "$.k").cast("long")
    return events.crossJoin(first).select("event_id", F.datediff(F.to_date("ts"), "first").cast("long").alias("day"), F.round(F.col("value") * 100).cast("long").alias("c0"), F.col("user_id").alias("c1"), k.alias("c2"))


def _anchors(n: int) -> list[tuple[int, int]]:
    at = range(ANCHOR_FIRST, n - NOMINAL_SAMPLES, ANCHOR_STEP)
    return [(ORIGIN + s, TICKS_0 + s * TICKS_PER_SAMPLE + i * i * 37 % 1000) for i, s in enumerate(at)]


def _notes(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # a table of fixed size
    return [synth.event_note(ORIGIN - 50 + r["n_nationkey"] // 2 * 100, r["n_name"], f"u{r['n_regionkey']}") for r in rows]


def recording(spark: SparkSession, sf_dir: str, kind: str = "days") -> Recording:
    """The recording of ``sf_dir``, encoded once in an application."""
    made = (spark.sparkContext.applicationId, sf_dir, kind)
    if made not in _made:
        rows = signals(spark, sf_dir)
        at = F.col("event_id") + LEAD + DAY_GAP * F.col("day") if kind in ("days", "broken") else F.col("event_id") + RUN_GAP * F.floor(F.col("event_id") / RUN)
        rows = rows.withColumn("at", at)
        n = rows.agg(F.max("at")).first()[0] + 1
        if kind in ("days", "broken"):
            n += TRAIL
            anchors = _anchors(n)
        else:
            anchors = [(ORIGIN, TICKS_0), (ORIGIN + n - 1, TICKS_0 + (n - 1) * TICKS_PER_SAMPLE)]
        _made[made] = synth.write(rows, scratch_dir(spark, f"recording-{kind}"), sample="at", values=["c0", "c1", "c2"], n_samples=n, rate=RATE, n_channels=CHANNELS, packet=PACKET, segment=SEGMENT, origin=ORIGIN, anchors=anchors, notes=_notes(spark, sf_dir))
    return Recording.open(spark, _made[made], limits=LIMITS, channels=None)


# The decoded samples, and projections of them

DAYS = f"""days AS (
  SELECT event_id, event_id + {LEAD} + {DAY_GAP} * date_diff('day', (SELECT CAST(min(ts) AS DATE) FROM events), CAST(ts AS DATE)) AS sample,
    CAST(round(value * 100) AS BIGINT) AS c0, user_id AS c1, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS c2 FROM events),
size AS (SELECT max(sample) + 1 + {TRAIL} AS n FROM days),
long AS (SELECT sample, CAST(channel AS INTEGER) AS channel, value FROM (
  SELECT sample, 0 AS channel, c0 AS value FROM days UNION ALL SELECT sample, 1, c1 FROM days UNION ALL SELECT sample, 2, c2 FROM days)),
packets AS (SELECT sample // {SEGMENT} AS segment_index, min(sample) AS start, max(sample) + 1 AS stop, count(*) AS span
  FROM days GROUP BY sample // {SEGMENT}, sample // {PACKET}, sample - event_id),
islands AS (SELECT min(sample) AS start, max(sample) + 1 AS stop FROM days GROUP BY sample - event_id)"""
WITH = f"WITH {DAYS} "


def decode_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored sample, decoded from the packets."""
    return recording(spark, sf_dir).samples()


def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range and number of each channel's samples, from blocks."""
    return coverage.block_range(recording(spark, sf_dir).blocks())


def decode_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels of a window of samples: only the packets that it touches are read."""
    r = recording(spark, sf_dir)
    return r.samples(r.n_samples // 4, r.n_samples // 2, [0, 2])


def channel_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection keeps its order and its repeats."""
    r = recording(spark, sf_dir)
    chosen = r.select([2, 0, 2])
    rows = F.broadcast(spark.createDataFrame(list(enumerate(chosen)), "row int, channel int"))
    return r.samples(channels=chosen).join(rows, "channel").select("row", "sample", "value")


def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All logical samples of all channels: null in gaps and on the shorted channel."""
    return coverage.filled_samples(recording(spark, sf_dir))


def missing_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical and missing samples of each channel."""
    return coverage.channel_counts(recording(spark, sf_dir)).select("channel", (F.col("stored") + F.col("missing")).alias("logical"), "missing")


def microvolts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_samples(spark, sf_dir).select("sample", "channel", (F.col("value") * UV_PER_COUNT).alias("uv"))


def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as deltas with a whole value at the start of each packet, and back by running sums."""
    blocks = recording(spark, sf_dir).blocks()
    each = blocks.select("channel", "start_sample", F.posexplode("values").alias("i", "value"), "values")
    before = F.get("values", F.col("i") - 1)
    deltas = each.select("channel", "start_sample", (F.col("start_sample") + F.col("i")).alias("sample"), (F.col("value") - before).alias("delta"), F.when(F.col("i") == 0, F.col("value")).alias("absolute"))
    return ranges.carried(deltas, ["channel", "start_sample"], "sample", "delta", "absolute", "value", bounded=True).select("sample", "channel", "value")


# Metadata

def packet_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with their bytes; the oracle works these out from the deltas."""
    p = recording(spark, sf_dir).packets()
    return p.select("segment_index", (F.col("sample_stamp") - ORIGIN).alias("start"), F.col("sample_span").cast("long").alias("span"), "sample_number", (F.col("byte_end") - F.col("byte_offset")).alias("bytes"))


def packet_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest and most bytes that each packet could have."""
    least, most = packet_byte_bounds(F.col("sample_span").cast("long"), CHANNELS, CHANNELS - 1)
    return recording(spark, sf_dir).packets().select((F.col("sample_stamp") - ORIGIN).alias("start"), least.alias("least"), most.alias("most"))


def packet_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a recording in whose indexes every tenth entry's stamp is one too small: it overlaps a packet right before it,
    and is sound after a gap."""
    r, made = recording(spark, sf_dir, "broken"), (spark.sparkContext.applicationId, sf_dir, "faults")
    if made not in _made:
        def alter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    fs, path = filesystem(uri)
                    with fs.open_input_file(path) as f:
                        data = bytearray(f.read())
                    entries = layout.parse_packets(bytes(data)).copy()
                    entries["stamp"][3::10] -= 1
                    with fs.open_output_stream(path, compression=None) as f:
                        f.write(bytes(data[: layout.HEADER]) + entries.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

        r.segments().select("etc").repartition(8).mapInArrow(alter, "n long").agg(F.sum("n")).collect()
        _made[made] = r.uri
    return r.packet_faults()


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of events as stamps and back, with the exclusive end after the last one, and how far the clock anchors reach."""
    r = recording(spark, sf_dir)
    every = signals(spark, sf_dir).select((F.col("event_id") + LEAD + DAY_GAP * F.col("day")).alias("sample"))
    every = every.unionByName(spark.range(r.n_samples, r.n_samples + 1).select(F.col("id").alias("sample")))
    both = every.withColumn("stamp", r.stamp_of(F.col("sample"))).withColumn("back", r.sample_of(F.col("stamp")))
    return both.crossJoin(F.broadcast(r.anchor_span()))  # a single row


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with the samples that their packets store."""
    r = recording(spark, sf_dir)
    sums = r.packets().groupBy("segment_index").agg(F.count("*").alias("packets"), F.sum("sample_span").alias("stored"))
    own = r.segments().select("segment_index", "start_stamp", "end_stamp", "stored_samples")
    return own.join(sums, "segment_index", "left").select("segment_index", "start_stamp", "end_stamp", "stored_samples", F.coalesce("packets", F.lit(0)).alias("packets"), F.coalesce("stored", F.lit(0)).alias("stored"))


def recording_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recording(spark, sf_dir).info().select("sample_rate", "n_samples", "n_recorded_channels", "segment_count", "start_stamp", "end_stamp", "duration_seconds")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recording(spark, sf_dir).channels().select("channel", "name", "shorted", "is_signal", "unit")


def _montage(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    """A note with a name for each slot of an expanded montage, from the first parts, inside syntax that isn't known."""
    parts = table(spark, sf_dir, "part").where(F.col("p_partkey") <= SLOTS).select("p_partkey", "p_name").collect()  # of fixed size
    names = dict(parts)
    slots = [None if i % 7 == 0 else "chan007" if i == 300 else names.get(i + 1) for i in range(SLOTS)]
    listed = notes.write_literal([*slots, *notes.AUXILIARY])
    return [(1, notes.write_literal({"ChanNames": ["older", "names"]})), (1, f"""(.(."Comment", "(.'ChanNames', ('quoted'))"), (."Geometry", [unknown]), (."ChanNames", {listed}))""")]


def montage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the channels of a wide recording with an expanded montage: blank ones get numbers that no slot's name has."""
    made = (spark.sparkContext.applicationId, sf_dir, "wide")
    if made not in _made:
        rows = signals(spark, sf_dir)
        n = rows.count()
        _made[made] = synth.write(rows, scratch_dir(spark, "recording-wide"), sample="event_id", values=["c0"], n_samples=n, rate=RATE, n_channels=WIDE, packet=PACKET, segment=SEGMENT, origin=ORIGIN, notes=_montage(spark, sf_dir))
    r = Recording.open(spark, _made[made], limits=LIMITS)
    stored = r.samples().groupBy("channel").agg(F.count("*").alias("stored"))
    return r.channels().join(stored, "channel", "left").select("channel", "name", "name_resolved", "is_signal", F.coalesce("stored", F.lit(0)).alias("stored"))


def stored_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.ranges_of(recording(spark, sf_dir))


def missing_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading, inner and trailing gaps."""
    return coverage.missing_of(recording(spark, sf_dir))


def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.validate(recording(spark, sf_dir)).drop("segments")


# Joins

def packet_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window around each event with the packets that it touches, clipped: an interval join of two large sides."""
    r = recording(spark, sf_dir)
    every = signals(spark, sf_dir).select("event_id", (F.col("event_id") + LEAD + DAY_GAP * F.col("day")).alias("sample"))
    windows = every.select("event_id", (F.col("sample") - 8).alias("lo"), (F.col("sample") + 9).alias("hi"))
    start = F.col("sample_stamp") - ORIGIN
    packets = r.packets().select(start.alias("start"), (start + F.col("sample_span")).alias("stop"))
    met = ranges.interval_join(windows, packets, [], PACKET)
    return met.select("event_id", F.col("start").alias("packet_start"), F.greatest("lo", "start").alias("first"), F.least("hi", "stop").alias("last"))


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item with the last order, at or before its date, of the customer whose key is its part's."""
    left = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("key"), F.col("l_shipdate").alias("at"))
    right = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("at")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return ranges.as_of(left, right, ["key"], "at", ["o_orderkey"]).drop("at")


def long_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days and orders of the customer's nation in a span after each order: an interval join of lengths from 0 to 4095."""
    day = lambda c: F.datediff(F.col(c), F.lit("1992-01-01")).cast("long")
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    orders = table(spark, sf_dir, "orders").join(nation, "o_custkey")
    spans = orders.select("o_orderkey", "nation", day("o_orderdate").alias("lo"), (day("o_orderdate") + F.pow(F.lit(4.0), F.col("o_orderkey") % 7).cast("long") - 1).alias("hi"))
    days = orders.groupBy("nation", day("o_orderdate").alias("start")).agg(F.count("*").alias("orders")).withColumn("stop", F.col("start") + 1)
    met = ranges.interval_join(spans, days, ["nation"], 4)
    return met.groupBy("o_orderkey").agg(F.count("*").alias("days"), F.sum("orders").alias("orders"))


def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums over all events, which are one key, that start anew at some users' events."""
    rows = table(spark, sf_dir, "events").select("event_id", F.lit(0).alias("one"), F.round(F.col("value") * 100).cast("long").alias("delta"), F.when(F.col("user_id") % 50 == 7, F.col("user_id")).alias("absolute"))
    return ranges.carried(rows, ["one"], "event_id", "delta", "absolute", "total").select("event_id", "total")


def _clocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = recording(spark, sf_dir)
    return clock.at_samples(spark.range(r.n_samples).select(F.col("id").alias("sample")), r.anchors(), ORIGIN, RATE, extrapolation="nominal", max_seconds=NOMINAL_SAMPLES / RATE)


def clock_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of every logical sample as an exact ratio, and how it was found."""
    return _clocked(spark, sf_dir).select("sample", F.col("numerator").cast("string").alias("numerator"), F.col("denominator").cast("string").alias("denominator"), "kind")


def clock_micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as microseconds since 1970, halves to even."""
    known = _clocked(spark, sf_dir).where("kind is not null")
    return known.select("sample", F.unix_micros(exact.ticks_to_timestamp(F.col("numerator"), F.col("denominator"))).alias("micros"))


# Chunks and codes

def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored and missing samples of chunks of 480."""
    return coverage.chunk_counts(recording(spark, sf_dir), 480)


def _limits() -> dict[str, str]:
    return {name: str(value) for name, value in LIMITS.items()}


def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of chunks of 1024 samples from a recording that is read as a stream."""
    return stream_chunk_stats(spark, recording(spark, sf_dir).uri, 1024, signal_channels="any", **_limits())


def source_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of samples and two channels, which options tell the data source; a condition on values stays with Spark."""
    r = recording(spark, sf_dir)
    datasource.register(spark)
    rows = spark.read.format(datasource.NAME).options(signal_channels="any", start=r.n_samples // 4, stop=r.n_samples // 2, channels="0,2", **_limits()).load(r.uri)
    return rows.where(F.col("value") % 2 == 0)


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = decode_samples(spark, sf_dir)
    uv = lambda c: F.col(c) * UV_PER_COUNT
    limits = coverage.channel_range(samples).select("channel", F.floor(F.least(uv("low"), uv("high"))).cast("double").alias("pmin"), F.ceil(F.greatest(uv("low"), uv("high"))).cast("double").alias("pmax"))
    both = samples.join(F.broadcast(limits), "channel").withColumn("uv", uv("value"))
    dmin, dmax = F.lit(signal.DIGITAL_MIN), F.lit(signal.DIGITAL_MAX)
    code = signal.quantised(F.col("uv"), F.col("pmin"), F.col("pmax"), dmin, dmax)
    return both.withColumn("code", code).withColumn("back", signal.restored(F.col("code"), F.col("pmin"), F.col("pmax"), dmin, dmax))


def quantised_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("sample", "channel", F.col("code").cast("long").alias("code"))


def quantisation_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many restored values of a channel lie beyond half a step, and the largest error in steps, to four places."""
    step = (F.col("pmax") - F.col("pmin")) / (signal.DIGITAL_MAX - signal.DIGITAL_MIN)
    error = F.abs(F.col("back") - F.col("uv"))
    worst = F.round(F.max(error / step), 4)
    return _codes(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"), F.count_if(error > step / 2 * (1 + 1e-9)).alias("beyond"), worst.alias("worst"))


def raw_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as whole steps of 2 from -32768 on; null where they aren't."""
    code = signal.raw_code(F.col("value"), F.lit(-signal.DIGITAL_MAX - 1), F.lit(2), F.lit(signal.DIGITAL_MIN))
    return decode_samples(spark, sf_dir).select("sample", "channel", code.alias("code"))


# Notes and labels

def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the notes file with their place in the order of stamps."""
    from pyspark.sql import Window

    found = recording(spark, sf_dir).events()  # bounded by max_ent_records
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("stamp", "ordinal"))
    return found.select(place.alias("place"), "stamp", "sample", "text", "user", "note_type")


def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events written as literals, parsed again, and read as JSON."""
    ship_package(spark)
    limits = ReadLimits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [notes.value_json(notes.write_literal({"type": t, "list": [json.loads(p), "a\"b\\c\n"]}), limits) for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.string())], names=["event_id", "value"])

    parsed = table(spark, sf_dir, "events").select("event_id", "event_type", "props").mapInArrow(run, "event_id long, value string")
    return parsed.select("event_id", F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.list[0].k").cast("long").alias("k"), F.get_json_object("value", "$.list[1]").alias("other"))


def legal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part names could be labels."""
    return table(spark, sf_dir, "part").select("p_partkey", signal.is_label(F.col("p_name")).alias("whole"), signal.is_label(F.substring("p_name", 1, 16)).alias("cut"))


def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of conversations with backslashes and control characters escaped."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", signal.escaped_column(F.col("text")).alias("escaped"))


# EDF+

def _plan(spark: SparkSession, sf_dir: str):
    r = recording(spark, sf_dir, "runs")
    return r, plan(r, timezone="UTC")


def edf_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sample and time of each record of a discontinuous file."""
    _, p = _plan(spark, sf_dir)
    return p.grid.table(spark).select("record", "start", (F.lit(float(p.origin)) + F.col("start") / RATE).alias("onset"))


def edf_event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each event: in a gap that after it, outside the nearest."""
    r, p = _plan(spark, sf_dir)
    return p.grid.placed(r.events(), "sample").select("ordinal", "sample", "record")


def _exported(spark: SparkSession, sf_dir: str) -> edf.EdfFile:
    made = (spark.sparkContext.applicationId, sf_dir, "edf")
    if made not in _made:
        r = recording(spark, sf_dir, "runs")
        path = f"{r.uri.removeprefix('file://')}/out.edf"
        edf.export(r, path, timezone="UTC")
        _made[made] = path
    return edf.EdfFile.open(spark, _made[made])


def edf_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of an exported, verified file, read back from it."""
    codes = _exported(spark, sf_dir).codes()
    return codes.select("record", "signal", F.posexplode("codes").alias("place", "code"))


def edf_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(spark, sf_dir).annotations().select("record", "ordinal", F.col("onset").cast("double").alias("onset"), "text")


def edf_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which codes of a damaged copy of the exported file differ from the recording: one of every third record, by a bit."""
    file, r = _exported(spark, sf_dir), recording(spark, sf_dir, "runs")
    copy, p = f"{file.path}.damaged.edf", plan(r, timezone="UTC")
    with open(file.path, "rb") as f, open(copy, "wb") as g:
        g.write(f.read(p.header_bytes))
        g.truncate(p.output_bytes)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(copy, "r+b") as g:
            for batch in batches:
                for record, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    data, at = bytearray(payload), 2 * (record % RUN) + 1
                    data[at] ^= 0x10 if record % 3 == 0 else 0
                    g.seek(p.header_bytes + record * p.record_bytes)
                    g.write(data)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    edf.raw_records(spark, file.stored).mapInArrow(put, "n long").agg(F.sum("n")).collect()
    return edf.differences(r, copy, p, edf.kinds_of(r, p, 0.5))


def _parts(spark: SparkSession, sf_dir: str) -> str:
    """The recording as a folder of parts, written by the data source and verified, once in an application."""
    made = (spark.sparkContext.applicationId, sf_dir, "parts")
    if made not in _made:
        r = recording(spark, sf_dir, "runs")
        edf_source.export(r, f"{r.uri}/out-parts.edf", timezone="UTC")
        _made[made] = f"{r.uri}/out-parts.edf"
    edf_source.register(spark)
    return _made[made]


def edf_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a file that the data source wrote in parts, read by the data source."""
    return spark.read.format("edf").load(_parts(spark, sf_dir)).select("record", "signal", "place", "code")


def edf_parts_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.format("edf").option("rows", "annotations").load(_parts(spark, sf_dir))
    return rows.select("record", "ordinal", F.col("onset").cast("double").alias("onset"), "text")


def saved_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by way of Parquet files; counts by channel and hundred."""
    saved = materialise(decode_samples(spark, sf_dir), "samples")
    return saved.groupBy("channel", F.floor(F.col("value") / 100).alias("hundred")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    decode_samples, channel_stats, decode_window, channel_selection, gap_fill, missing_by_channel, microvolts, delta_decode,
    packet_index, packet_bounds, packet_faults, conversions, segments, recording_info, channels, montage, stored_ranges, missing_ranges, validate,
    packet_overlap, long_overlap, as_of, running_total, clock_exact, clock_micros, chunk_counts, stream_chunks, source_window, quantised_codes, quantisation_error, raw_codes,
    events, literals, legal_labels, escaped_texts, edf_records, edf_event_records, edf_codes, edf_annotations, edf_damage, edf_parts, edf_parts_annotations, saved_samples,
)}

UV = f"CAST('{UV_PER_COUNT!r}' AS DOUBLE)"
FILLED = f"""cells AS (SELECT g.sample, CAST(c.channel AS INTEGER) AS channel, v.value FROM (SELECT unnest(range(0, (SELECT n FROM size))) AS sample) g
  CROSS JOIN (SELECT unnest(range(0, {CHANNELS})) AS channel) c LEFT JOIN long v ON v.sample = g.sample AND v.channel = c.channel)"""
CODES = f"""limits AS (SELECT channel, floor(least(min(value) * {UV}, max(value) * {UV})) AS pmin, ceil(greatest(min(value) * {UV}, max(value) * {UV})) AS pmax FROM long GROUP BY channel),
codes AS (SELECT sample, channel, value * {UV} AS uv, pmin, pmax, round_even((value * {UV} - pmin) * (65535 / (pmax - pmin)) + -32768, 0) AS code FROM long JOIN limits USING (channel))"""
ANCHORS = f"""anchors AS (SELECT s0, t0, lead(s0) OVER (ORDER BY s0) AS s1, lead(t0) OVER (ORDER BY s0) AS t1 FROM (
  SELECT {ANCHOR_FIRST} + i * {ANCHOR_STEP} AS s0, {TICKS_0} + ({ANCHOR_FIRST} + i * {ANCHOR_STEP}) * {TICKS_PER_SAMPLE} + i * i * 37 % 1000 AS t0
  FROM (SELECT unnest(range(0, 1 + ((SELECT n FROM size) - {NOMINAL_SAMPLES} - {ANCHOR_FIRST} - 1) // {ANCHOR_STEP})) AS i))),
ends AS (SELECT min(s0) AS a, max(s0) AS b, arg_min(t0, s0) AS ta, arg_max(t0, s0) AS tb FROM anchors),
met AS (SELECT g.sample, s0, s1, CAST(t0 AS HUGEINT) AS t0, CAST(t1 AS HUGEINT) AS t1, ends.*, CASE WHEN g.sample < a THEN g.sample - a ELSE g.sample - b END AS away
  FROM (SELECT unnest(range(0, (SELECT n FROM size))) AS sample) g LEFT JOIN anchors ON g.sample >= s0 AND g.sample < coalesce(s1, s0 + 1) CROSS JOIN ends),
kinds AS (SELECT *, CASE WHEN sample = s0 THEN 'anchor' WHEN s1 IS NOT NULL THEN 'interpolated' WHEN abs(away) <= {NOMINAL_SAMPLES} THEN 'extrapolated_nominal' END AS kind FROM met),
exact AS (SELECT sample, kind, CASE kind WHEN 'anchor' THEN t0 WHEN 'interpolated' THEN t0 * (s1 - s0) + (t1 - t0) * (sample - s0)
  WHEN 'extrapolated_nominal' THEN CAST(CASE WHEN sample < a THEN ta ELSE tb END AS HUGEINT) + away * {TICKS_PER_SAMPLE} END AS num,
  CASE kind WHEN 'anchor' THEN 1 WHEN 'interpolated' THEN s1 - s0 WHEN 'extrapolated_nominal' THEN 1 END AS den FROM kinds)"""
RUNS = f"""runs AS (SELECT event_id // {RUN} AS record, event_id % {RUN} AS place, CAST(round(value * 100) AS BIGINT) AS c0, user_id AS c1, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS c2 FROM events),
total AS (SELECT count(DISTINCT record) AS n FROM runs),
marks AS (SELECT n_nationkey, n_name, n_nationkey // 2 * 100 - 50 AS sample FROM nation),
placed AS (SELECT m.*, greatest(0, least((SELECT n FROM total) - 1, CASE WHEN sample < 0 THEN 0 ELSE sample // {RUN + RUN_GAP} END)) AS span FROM marks m),
marked AS (SELECT *, CASE WHEN sample >= span * {RUN + RUN_GAP} + {RUN} AND span + 1 < (SELECT n FROM total) THEN span + 1 ELSE span END AS record FROM placed)"""

ORACLE_SQL = {
    "decode_samples": WITH + f"SELECT sample, sample + {ORIGIN} AS stamp, channel, value FROM long",
    "channel_stats": WITH + "SELECT channel, min(value) AS low, max(value) AS high, count(*) AS n FROM long GROUP BY channel",
    "decode_window": WITH + f"SELECT sample, sample + {ORIGIN} AS stamp, channel, value FROM long, size WHERE sample >= n // 4 AND sample < n // 2 AND channel IN (0, 2)",
    "channel_selection": WITH + "SELECT CAST(r.row AS INTEGER) AS row, sample, value FROM long JOIN (VALUES (0, 2), (1, 0), (2, 2)) r(row, channel) USING (channel)",
    "gap_fill": WITH + f", {FILLED} SELECT sample, channel, value FROM cells",
    "missing_by_channel": WITH + f", {FILLED} SELECT channel, count(*) AS logical, count(*) - count(value) AS missing FROM cells GROUP BY channel",
    "microvolts": WITH + f"SELECT sample, channel, value * {UV} AS uv FROM long",
    "delta_decode": WITH + "SELECT sample, channel, value FROM long",
    "packet_index": WITH + f""", steps AS (SELECT d.*, lag(c0) OVER w AS p0, lag(c1) OVER w AS p1, lag(c2) OVER w AS p2 FROM days d WINDOW w AS (PARTITION BY sample // {PACKET}, sample - event_id ORDER BY sample)),
bytes AS (SELECT sample, event_id, 2 + {" + ".join(f"(CASE WHEN p{i} IS NULL THEN 6 WHEN c{i} - p{i} BETWEEN -128 AND 127 THEN 1 WHEN c{i} - p{i} BETWEEN -32768 AND 32767 THEN 2 ELSE 6 END)" for i in range(3))} AS b FROM steps),
sizes AS (SELECT sample // {SEGMENT} AS segment_index, min(sample) AS start, count(*) AS span, sum(b) AS bytes FROM bytes GROUP BY sample // {SEGMENT}, sample // {PACKET}, sample - event_id)
SELECT CAST(segment_index AS INTEGER) AS segment_index, start, span, CAST(coalesce(sum(span) OVER (PARTITION BY segment_index ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sample_number, CAST(bytes AS BIGINT) AS bytes FROM sizes""",
    "packet_bounds": WITH + "SELECT start, 20 + (span - 1) * 5 AS least, span * 20 AS most FROM packets",
    "packet_faults": WITH + """, placed AS (SELECT segment_index, start, lag(stop) OVER w AS before, row_number() OVER w - 1 AS i FROM packets WINDOW w AS (PARTITION BY segment_index ORDER BY start))
SELECT CAST(segment_index AS INTEGER) AS segment_index, CAST(i AS INTEGER) AS packet_index, 'overlap' AS fault FROM placed WHERE i % 10 = 3 AND before = start""",
    "conversions": WITH + f""", every AS (SELECT sample FROM days UNION ALL SELECT n FROM size)
SELECT sample, sample + {ORIGIN} AS stamp, sample AS back, CAST({ANCHOR_FIRST} AS BIGINT) AS first_anchor_sample, {ANCHOR_FIRST} + (n - {NOMINAL_SAMPLES} - {ANCHOR_FIRST} - 1) // {ANCHOR_STEP} * {ANCHOR_STEP} AS last_anchor_sample FROM every, size""",
    "segments": WITH + f"""SELECT CAST(i AS INTEGER) AS segment_index, {ORIGIN} + i * {SEGMENT} AS start_stamp, {ORIGIN} + least((SELECT n FROM size), (i + 1) * {SEGMENT}) - 1 AS end_stamp,
CAST(coalesce(sum(span), 0) AS BIGINT) AS stored_samples, count(span) AS packets, CAST(coalesce(sum(span), 0) AS BIGINT) AS stored
FROM (SELECT unnest(range(0, ((SELECT n FROM size) + {SEGMENT - 1}) // {SEGMENT})) AS i) LEFT JOIN packets ON segment_index = i GROUP BY i""",
    "recording_info": WITH + f"SELECT CAST({RATE} AS DOUBLE) AS sample_rate, n AS n_samples, {CHANNELS} AS n_recorded_channels, CAST((n + {SEGMENT - 1}) // {SEGMENT} AS INTEGER) AS segment_count, CAST({ORIGIN} AS BIGINT) AS start_stamp, {ORIGIN} + n - 1 AS end_stamp, CAST(n AS DOUBLE) / CAST({RATE} AS DOUBLE) AS duration_seconds FROM size",
    "channels": "SELECT CAST(i AS INTEGER) AS channel, 'chan00' || i AS name, i = 3 AS shorted, true AS is_signal, 'uV' AS unit FROM (SELECT unnest(range(0, 4)) AS i)",
    "montage": f"""WITH slots AS (SELECT i, CASE WHEN i % 7 = 0 THEN NULL WHEN i = 300 THEN 'chan007' ELSE p_name END AS name FROM (SELECT unnest(range(0, {SLOTS})) AS i) LEFT JOIN part ON p_partkey = i + 1),
aux AS (SELECT i + 256 AS i, CASE i WHEN 16 THEN 'TRIG' WHEN 17 THEN 'OSAT' WHEN 18 THEN 'PR' WHEN 19 THEN 'Pleth' ELSE 'DC' || (i + 1) END AS name FROM (SELECT unnest(range(0, 20)) AS i)),
given AS (SELECT i, name FROM slots WHERE i < 256 UNION ALL SELECT i, name FROM aux)
SELECT CAST(i AS INTEGER) AS channel, coalesce(name, 'chan' || lpad(CAST(i AS VARCHAR), 3, '0') || CASE WHEN i = 7 THEN '_1' ELSE '' END) AS name, name IS NOT NULL AS name_resolved, i < 256 AS is_signal,
CASE WHEN i = 0 THEN (SELECT count(*) FROM events) ELSE 0 END AS stored FROM given""",
    "stored_ranges": WITH + "SELECT start, stop FROM islands",
    "missing_ranges": WITH + "SELECT * FROM (SELECT coalesce(lag(stop) OVER (ORDER BY start), 0) AS start, start AS stop FROM islands UNION ALL SELECT max(stop), (SELECT n FROM size) FROM islands) WHERE start < stop",
    "validate": WITH + f"SELECT n AS logical_samples, (SELECT count(*) FROM packets) AS packets, (SELECT count(*) FROM days) AS stored_samples, CAST({LEAD} AS BIGINT) AS missing_leading, CAST({TRAIL} AS BIGINT) AS missing_trailing, n - (SELECT count(*) FROM days) AS missing_samples, (SELECT count(*) FROM nation) AS notes, CAST(0 AS BIGINT) AS unparsed_notes, (SELECT count(*) FROM nation) AS events FROM size",
    "packet_overlap": WITH + "SELECT event_id, start AS packet_start, greatest(sample - 8, start) AS first, least(sample + 9, stop) AS last FROM days JOIN packets ON sample - 8 < stop AND start < sample + 9",
    "long_overlap": """WITH o AS (SELECT o_orderkey, c_nationkey AS nation, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS lo FROM orders JOIN customer ON o_custkey = c_custkey),
days AS (SELECT nation, lo AS start, count(*) AS orders FROM o GROUP BY ALL)
SELECT o_orderkey, count(*) AS days, CAST(sum(orders) AS BIGINT) AS orders FROM o JOIN days ON o.nation = days.nation AND start >= lo AND start < lo + CAST(pow(4, o_orderkey % 7) AS BIGINT) - 1 GROUP BY o_orderkey""",
    "running_total": """WITH e AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS delta, CASE WHEN user_id % 50 = 7 THEN user_id END AS absolute, count(absolute) OVER (ORDER BY event_id) AS run FROM events)
SELECT event_id, CASE WHEN run > 0 THEN CAST(sum(coalesce(absolute, delta)) OVER (PARTITION BY run ORDER BY event_id) AS BIGINT) END AS total FROM e""",
    "as_of": "SELECT l_orderkey, l_linenumber, l_partkey AS key, o_orderkey FROM lineitem ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON l_partkey = o_custkey AND l_shipdate >= o_orderdate",
    "clock_exact": WITH + f", {ANCHORS} SELECT sample, CAST(num AS VARCHAR) AS numerator, CAST(den AS VARCHAR) AS denominator, kind FROM exact",
    "clock_micros": WITH + f""", {ANCHORS}, parts AS (SELECT sample, num // (den * 10) AS q, num % (den * 10) * 2 AS twice, den * 10 AS d FROM exact WHERE kind IS NOT NULL)
SELECT sample, CAST(q + CASE WHEN twice > d OR (twice = d AND q % 2 = 1) THEN 1 ELSE 0 END - 11644473600000000 AS BIGINT) AS micros FROM parts""",
    "chunk_counts": WITH + f", {FILLED} SELECT sample // 480 AS chunk, channel, count(value) AS stored, count(*) - count(value) AS missing FROM cells GROUP BY ALL",
    "stream_chunks": WITH + "SELECT sample // 1024 AS chunk, channel, min(value) AS low, max(value) AS high, count(*) AS n FROM long GROUP BY ALL",
    "source_window": WITH + f"SELECT sample, sample + {ORIGIN} AS stamp, channel, value FROM long, size WHERE sample >= n // 4 AND sample < n // 2 AND channel IN (0, 2) AND value % 2 = 0",
    "quantised_codes": WITH + f", {CODES} SELECT sample, channel, CAST(code AS BIGINT) AS code FROM codes",
    "quantisation_error": WITH + f""", {CODES}, back AS (SELECT *, abs((code + 32768) * ((pmax - pmin) / 65535) + pmin - uv) AS error, (pmax - pmin) / 65535 AS step FROM codes)
SELECT channel, count(*) AS n, count(*) FILTER (error > step / 2 * (1 + 1e-9)) AS beyond, round(max(error / step), 4) AS worst FROM back GROUP BY channel""",
    "raw_codes": WITH + "SELECT sample, channel, CASE WHEN value + 32768 >= 0 AND (value + 32768) % 2 = 0 THEN (value + 32768) // 2 - 32768 END AS code FROM long",
    "events": f"SELECT CAST(n_nationkey + 1 AS INTEGER) AS place, CAST({ORIGIN} - 50 + n_nationkey // 2 * 100 AS BIGINT) AS stamp, CAST(n_nationkey // 2 * 100 - 50 AS BIGINT) AS sample, n_name AS text, 'u' || n_regionkey AS \"user\", CAST(1 AS INTEGER) AS note_type FROM nation",
    "literals": "SELECT event_id, event_type AS type, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, 'a\"b\\c' || chr(10) AS other FROM events",
    "legal_labels": "SELECT p_partkey, regexp_full_match(p_name, '[ -~]{1,16}') AND trim(p_name) = p_name AND p_name <> 'EDF Annotations' AS whole, regexp_full_match(p_name[1:16], '[ -~]{1,16}') AND trim(p_name[1:16]) = p_name[1:16] AND p_name[1:16] <> 'EDF Annotations' AS cut FROM part",
    "escaped_texts": "SELECT conv_id, turn, " + "replace(" * 33 + r"replace(text, '\', '\\')" + "".join(rf", chr({c}), '\u{c:04x}')" for c in [*range(1, 32), 127]) + ", '', '') AS escaped FROM conversations",
    "edf_records": f"WITH {RUNS} SELECT CAST(i AS BIGINT) AS record, CAST(i * {RUN + RUN_GAP} AS BIGINT) AS start, CAST(i * {RUN + RUN_GAP} AS DOUBLE) / CAST({RATE} AS DOUBLE) AS onset FROM (SELECT unnest(range(0, (SELECT n FROM total))) AS i)",
    "edf_event_records": f"WITH {RUNS} SELECT CAST(n_nationkey AS INTEGER) AS ordinal, CAST(sample AS BIGINT) AS sample, CAST(record AS BIGINT) AS record FROM marked",
    "edf_codes": f"""WITH {RUNS}, long AS (SELECT record, 0 AS signal, place, c0 AS value FROM runs UNION ALL SELECT record, 1, place, c1 FROM runs UNION ALL SELECT record, 2, place, c2 FROM runs),
limits AS (SELECT signal, floor(least(min(value) * {UV}, max(value) * {UV})) AS pmin, ceil(greatest(min(value) * {UV}, max(value) * {UV})) AS pmax FROM long GROUP BY signal)
SELECT record, CAST(signal AS INTEGER) AS signal, CAST(place AS INTEGER) AS place, CAST(round_even((value * {UV} - pmin) * (65535 / (pmax - pmin)) + -32768, 0) AS BIGINT) AS code FROM long JOIN limits USING (signal)
UNION ALL SELECT record, 3, CAST(place AS INTEGER), 32767 FROM runs""",
    "edf_damage": f"""WITH {RUNS}, long AS (SELECT record, place, c0 AS value FROM runs),
limits AS (SELECT floor(least(min(value) * {UV}, max(value) * {UV})) AS pmin, ceil(greatest(min(value) * {UV}, max(value) * {UV})) AS pmax FROM long)
SELECT CAST(record AS BIGINT) AS record, CAST(0 AS INTEGER) AS signal, CAST(place AS INTEGER) AS place, xor(CAST(round_even((value * {UV} - pmin) * (65535 / (pmax - pmin)) + -32768, 0) AS BIGINT), CAST(4096 AS BIGINT)) AS code, value AS source
FROM long, limits WHERE record % 3 = 0 AND place = record % {RUN}""",
    "edf_annotations": f"""WITH {RUNS} SELECT CAST(i AS BIGINT) AS record, CAST(0 AS INTEGER) AS ordinal, CAST(i * {RUN + RUN_GAP} AS DOUBLE) / CAST({RATE} AS DOUBLE) AS onset, '' AS text FROM (SELECT unnest(range(0, (SELECT n FROM total))) AS i)
UNION ALL SELECT CAST(record AS BIGINT), CAST(row_number() OVER (PARTITION BY record ORDER BY sample, n_nationkey) AS INTEGER), CAST(sample AS DOUBLE) / CAST({RATE} AS DOUBLE), n_name FROM marked""",
    "saved_samples": WITH + "SELECT channel, CAST(floor(value / 100) AS BIGINT) AS hundred, count(*) AS n FROM long GROUP BY ALL",
}
ORACLE_SQL |= {"edf_parts": ORACLE_SQL["edf_codes"], "edf_parts_annotations": ORACLE_SQL["edf_annotations"]}
