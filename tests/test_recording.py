"""A small recording with gaps: reads, budgets, refusals and EDF files."""

import os
import uuid

import numpy as np
import pytest

from sparkwave.errors import DataIntegrityError, ResourceLimitError, UnsupportedFormatError
from sparkwave.functions import notes as note_functions
from sparkwave.limits import ReadLimits
from sparkwave.operators import coverage, ranges
from sparkwave.plans.edf import plan
from sparkwave.session import scratch_dir
from sparkwave.sources import edf, synth
from sparkwave.sources.layout import UV_PER_COUNT
from sparkwave.sources.recording import Recording

N = 320


@pytest.fixture(scope="module")
def folder(spark):
    rows = spark.createDataFrame([(s, 1500 + s * 7 % 257 * 2, s - 100) for s in range(N) if not 64 <= s < 128], "s long, a long, b long")
    notes = [synth.event_note(1010, "marker", "me"), synth.event_note(1070, "in the gap", "me")]
    return synth.write(rows, scratch_dir(spark, "small"), sample="s", values=["a", "b"], n_samples=N, rate=512.0, n_channels=3, packet=32, segment=160, anchors=[(1000, 132 * 10**15), (1319, 132 * 10**15 + 319 * 19531)], notes=notes)


@pytest.fixture(scope="module")
def recording(spark, folder):
    return Recording.open(spark, folder, channels=None)


def test_matrix_has_gaps_and_units(recording):
    raw = recording.matrix(60, 132, [1, 2, 0, 1], "digital")
    assert raw.shape == (4, 72) and np.isnan(raw[0, 4:68]).all() and np.isnan(raw[1]).all()
    assert raw[0, 0] == -40 and (raw[0][[0, 71]] == raw[3][[0, 71]]).all()
    assert np.allclose(recording.matrix(0, 5, 1), np.arange(-100, -95) * UV_PER_COUNT)
    parts = np.concatenate(list(recording.chunks(0, 200, chunk_samples=70, channels=[0])), axis=1)
    assert np.array_equal(parts, recording.matrix(0, 200, [0]), equal_nan=True)


def test_ranges_and_counts(recording):
    assert sorted(map(tuple, coverage.ranges_of(recording).collect())) == [(0, 64), (128, 320)]
    assert coverage.validate(recording).first().asDict() == {"segments": 2, "logical_samples": 320, "packets": 8, "stored_samples": 256, "missing_leading": 0, "missing_trailing": 0, "missing_samples": 64, "notes": 2, "unparsed_notes": 0, "events": 2}


def test_arguments_are_checked(spark, folder, recording):
    for bad in ((-1, 5), (5, 4), (0, N + 1)):
        with pytest.raises(IndexError):
            recording.window(*bad)
    with pytest.raises(TypeError):
        recording.window(True, 5)
    with pytest.raises(IndexError):
        recording.select(3)
    with pytest.raises(ValueError):
        recording.select("no such channel")
    with pytest.raises(ResourceLimitError):
        Recording.open(spark, folder, channels=None, limits=ReadLimits(max_read_samples=10)).matrix(0, 11)
    with pytest.raises(ResourceLimitError):
        Recording.open(spark, folder, channels=None, limits=ReadLimits(max_segments=1))
    with pytest.raises(UnsupportedFormatError):
        Recording.open(spark, folder)  # 276 channels unless said otherwise
    with pytest.raises(FileNotFoundError):
        Recording.open(spark, f"{folder}/none.stc")


def test_a_read_is_estimated_before_it_starts(spark, folder, recording):
    assert recording.scan_size(0, N) == 2 * 256 and recording.scan_size(0, N, [0]) == 256 and recording.scan_size(10, 20, [0, 2, 0]) == 10 and recording.scan_size(5, 5) == 0
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    small = Recording.open(spark, folder, channels=None, limits=ReadLimits(max_scan_values=300))
    before = jobs()
    for read in (small.samples, small.blocks, small.ranges):
        with pytest.raises(ResourceLimitError, match="values of a read: 512"):
            read()
    assert jobs() == before and small.samples(0, 160, [0]).count() == 96


def test_conversions_with_the_exclusive_end(spark, recording):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0,), (N,), (None,)], "s long").select("s", recording.stamp_of(F.col("s")).alias("t")).withColumn("back", recording.sample_of(F.col("t")))
    assert [tuple(r) for r in rows.collect()] == [(0, 1000, 0), (N, 1000 + N, N), (None, None, None)]
    for bad in (-1, N + 1):
        for column in (recording.stamp_of(F.lit(bad)), recording.sample_of(F.lit(1000 + bad))):
            with pytest.raises(Exception, match="outside the recording"):
                spark.range(1).select(column).collect()
    assert tuple(recording.anchor_span().first()) == (0, 319)


def test_a_changed_index_is_refused(spark, folder):
    rows = spark.createDataFrame([(s, s) for s in range(64)], "s long, a long")
    other = synth.write(rows, scratch_dir(spark, "broken"), sample="s", values=["a"], n_samples=64, rate=512.0, n_channels=1, packet=32, segment=64)
    path = f"{other.removeprefix('file://')}/seg00000.etc"
    with open(path, "r+b") as f:
        f.seek(352 + 16 + 4)
        f.write((1010).to_bytes(4, "little"))  # the second packet now overlaps the first
    broken = Recording.open(spark, other, channels=None)
    assert [tuple(r) for r in broken.packet_faults().collect()] == [(0, 1, "overlap")]
    for read in (broken.samples().count, lambda: broken.matrix(0, 10, units="digital"), lambda: coverage.validate(broken).collect()):
        with pytest.raises(Exception, match="overlap"):
            read()


def test_a_recording_without_samples_misses_all(spark):
    none = spark.createDataFrame([], "s long, a long")
    empty = Recording.open(spark, synth.write(none, scratch_dir(spark, "empty"), sample="s", values=["a"], n_samples=100, rate=512.0, n_channels=1, packet=32, segment=64), channels=None)
    row = coverage.validate(empty).first()
    assert (row["stored_samples"], row["missing_samples"], row["missing_leading"]) == (0, 100, 100)
    assert np.isnan(empty.matrix(0, 100)).all() and coverage.ranges_of(empty).count() == 0


def test_only_typed_notes_are_events(spark):
    rows = spark.createDataFrame([(s, s) for s in range(8)], "s long, a long")
    given = [{"Stamp": 1004, "Text": "yes", "Data": {"User": 12}}, {"Stamp": "6", "Text": "text stamp"}, {"Stamp": True, "Text": "flag"}, {"Stamp": 1001, "Text": 7}, {"Stamp": 1001, "Text": True}, {"Stamp": 1001.5, "Text": "half"}, {"Stamp": 1002, "Text": "first", "Data": {"User": "me"}}]
    notes = [(1, note_functions.write_literal(n)) for n in given]
    r = Recording.open(spark, synth.write(rows, scratch_dir(spark, "typed"), sample="s", values=["a"], n_samples=8, rate=512.0, n_channels=1, packet=8, segment=8, notes=notes), channels=None)
    assert [(e["stamp"], e["text"], e["user"]) for e in r.events().collect()] == [(1002, "first", "me"), (1004, "yes", None)]


def test_links_are_refused(spark, folder):
    path = f"{folder.removeprefix('file://')}"
    other = f"{path}-linked"
    os.mkdir(other)
    for name in os.listdir(path):
        os.symlink(f"{path}/{name}", f"{other}/{name}")
    with pytest.raises(DataIntegrityError, match="link"):
        Recording.open(spark, f"file://{other}", channels=None)


def test_edf_round_trip(spark, recording):
    path = f"/tmp/checkpoints/{uuid.uuid4().hex}.edf"
    result = edf.export(recording, path, timezone="UTC")
    assert (result.format, result.records, result.stored_samples, os.path.getsize(path)) == ("EDF+D", 4, 256, result.output_bytes)
    with pytest.raises(FileExistsError):
        edf.export(recording, path, timezone="UTC")
    with pytest.raises(ValueError):
        edf.export(recording, path[:-4])
    back = edf.EdfFile.open(spark, path)
    rows = back.annotations().orderBy("record", "ordinal").collect()
    assert [(r["record"], r["text"]) for r in rows if r["text"]] == [(0, "marker"), (1, "in the gap")]
    assert all(set(r["codes"]) == {32767} for r in back.codes().where("signal = 2").collect())


def test_a_changed_edf_file_is_refused(spark, recording):
    path = f"/tmp/checkpoints/{uuid.uuid4().hex}.edf"
    edf.export(recording, path, timezone="UTC")
    p = plan(recording, timezone="UTC")
    kinds = edf.kinds_of(recording, p, 0.5)
    assert edf.verify(recording, path, p, kinds) <= 0.5
    good = open(path, "rb").read()
    places = {"code": p.header_bytes + p.record_bytes + 1, "disconnected": p.header_bytes + 2 * 2 * p.grid.points, "note": p.header_bytes + 3 * p.record_bytes + 3 * 2 * p.grid.points + 1, "header": 30}
    for at in places.values():
        with open(path, "wb") as f:
            f.write(good[:at] + bytes([good[at] ^ 0x55]) + good[at + 1 :])
        with pytest.raises(DataIntegrityError):
            edf.verify(recording, path, p, kinds)


def test_parts_of_records_and_any_order_of_channels(spark, recording):
    path = f"/tmp/checkpoints/{uuid.uuid4().hex}.edf"
    edf.export(recording, path, timezone="UTC", channels=[1, 0])
    codes = {(r["record"], r["signal"]): r["codes"] for r in edf.EdfFile.open(spark, path).codes().collect()}
    a, b = (np.concatenate([codes[k] for k in sorted(codes) if k[1] == i]) for i in (1, 0))
    stored = [s for s in range(N) if not 64 <= s < 128]
    wanted = [np.array([1500 + s * 7 % 257 * 2 for s in stored]), np.array([s - 100 for s in stored])]
    for found, counts in zip((a, b), wanted, strict=True):
        assert np.corrcoef(found, -counts)[0, 1] > 0.999999  # a count is a negative number of microvolts


def test_range_operators(spark):
    stored = spark.createDataFrame([("x", 0, 5), ("x", 5, 9), ("x", 12, 20), ("y", 3, 4)], "k string, start long, stop long")
    assert sorted(map(tuple, ranges.islands(stored, ["k"]).collect())) == [("x", 0, 9), ("x", 12, 20), ("y", 3, 4)]
    assert ranges.overlaps(stored.union(stored.limit(1)), ["k"]).count() == 1
    windows = spark.createDataFrame([("x", 4, 13), ("x", 9, 12), ("y", 0, 100), ("z", 0, 1)], "k string, lo long, hi long")
    met = ranges.interval_join(windows, stored, ["k"], 4)
    assert sorted((r["lo"], r["start"]) for r in met.collect()) == [(0, 3), (4, 0), (4, 5), (4, 12)]
    empty = stored.where("false")
    assert ranges.islands(empty, ["k"]).count() == 0 == ranges.interval_join(windows, empty, ["k"], 4).count()
