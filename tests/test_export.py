"""Exports that fail leave nothing, whatever fails; what they tell; wide recordings; differences as rows."""

import os
import shutil
import tempfile

import numpy as np
import pytest

from sparkwave.errors import DataIntegrityError
from sparkwave.functions.signal import ONLY_COUNT
from sparkwave.plans.edf import plan
from sparkwave.sources import edf, synth
from sparkwave.sources.recording import Recording

ANCHORS = [(1000, 132 * 10**15), (1319, 132 * 10**15 + 319 * 19531)]


@pytest.fixture(scope="module")
def folder(spark):
    made = tempfile.mkdtemp(prefix="spark-export-")
    rows = spark.createDataFrame([(s, 1500 + s * 7 % 257 * 2, s - 100) for s in range(320) if not 64 <= s < 128], "s long, a long, b long")
    synth.write(rows, f"file://{made}/rec", sample="s", values=["a", "b"], n_samples=320, rate=512.0, n_channels=3, packet=32, segment=160, anchors=ANCHORS, notes=[synth.event_note(1010, "marker", "me")])
    yield made
    shutil.rmtree(made)


@pytest.fixture
def recording(spark, folder):
    return Recording.open(spark, f"file://{folder}/rec", channels=None)


def export(recording, folder, **options):
    return edf.export(recording, f"{folder}/out.edf", timezone="UTC", **options)


@pytest.fixture(autouse=True)
def nothing_is_left(folder):
    yield
    left = [n for n in os.listdir(folder) if n != "rec"]
    for name in left:
        os.unlink(f"{folder}/{name}")
    assert left in ([], ["out.edf"]), left


def test_what_it_tells_and_returns(recording, folder, capfd):
    events = []
    done = export(recording, folder, progress=events.append)
    final = [e for e in events if "of" not in e]
    assert [e["stage"] for e in final] == ["planned", "range_scan", "write", "verify", "publishing"]
    assert final[2] == {"stage": "write", "records": 4, "total": 4} and final[1]["samples"] == 256 and final[4]["file_bytes"] == done.output_bytes
    assert all(e["tasks"] <= e["of"] for e in events if "of" in e)
    assert done.channels[0][0] == 0 and [c for c, _, _ in done.channels] == [0, 1, 2] and done.channels[0][2] == "uV" and done.shorted_channels == (2,)
    assert done.logical_samples == 320 and done.stored_ranges == ((0, 64), (128, 320)) and float(done.gap_seconds) == 0.125 and done.event_count == 1
    os.unlink(done.path)
    for silent in (False, None):
        os.unlink(export(recording, folder, progress=silent).path)
    assert "EDF export" not in capfd.readouterr().err
    os.unlink(export(recording, folder, progress=True).path)
    assert "stage write, records 4" in capfd.readouterr().err
    with pytest.raises(TypeError):
        export(recording, folder, progress="yes")


@pytest.mark.parametrize("stage", ["planned", "range_scan", "write", "verify", "publishing"])
def test_a_callback_that_stops_or_changes_the_source(recording, folder, stage):
    def stop(event):
        if event["stage"] == stage:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        export(recording, folder, progress=stop)

    def change(event):
        if event["stage"] == stage and "of" not in event:
            os.utime(f"{folder}/rec/rec.snc", (1, 1 + len(stage)))

    with pytest.raises(DataIntegrityError, match="changed"):
        export(recording, folder, progress=change)
    assert not [n for n in os.listdir(folder) if n != "rec"]


def test_a_name_that_is_taken_at_the_last_moment(recording, folder):
    def race(event):
        if event["stage"] == "publishing":
            with open(f"{folder}/out.edf", "w") as f:
                f.write("another's")

    with pytest.raises(FileExistsError):
        export(recording, folder, progress=race)
    assert open(f"{folder}/out.edf").read() == "another's"


def test_failures_of_tasks_disks_and_publication(recording, folder, monkeypatch):
    real = edf.encoded

    def failing(recording, p, kinds):
        def fail(batches):
            for i, batch in enumerate(batches):
                yield batch
                raise OSError("no more disk")

        return real(recording, p, kinds).mapInArrow(fail, edf.RECORDS)

    with monkeypatch.context() as m:
        m.setattr(edf, "encoded", failing)
        with pytest.raises(Exception, match="no more disk"):
            export(recording, folder)
    with monkeypatch.context() as m:
        m.setattr(edf, "encoded", lambda *a: real(*a).where("record <> 1"))
        with pytest.raises(DataIntegrityError, match="weren't written"):
            export(recording, folder)
    planned = []
    with monkeypatch.context() as m:
        m.setattr(edf, "plan", lambda *a, **b: planned.append(1))
        m.setattr(os, "link", lambda *a: (_ for _ in ()).throw(OSError("no links here")))
        with pytest.raises(OSError, match="no links here"):
            export(recording, folder)
    assert not planned  # found before any work
    with monkeypatch.context() as m:
        m.setattr(edf, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost the folder")))
        with pytest.raises(OSError, match="lost the folder"):
            export(recording, folder)
    with monkeypatch.context() as m:
        m.setattr(os, "statvfs", lambda _: os.statvfs_result((1, 1, 0, 0, 0, 0, 0, 0, 0, 255)))
        with pytest.raises(OSError, match="space"):
            export(recording, folder)
    assert not [n for n in os.listdir(folder) if n != "rec"]


def test_differences_are_rows(recording, folder):
    done = export(recording, folder)
    p = plan(recording, timezone="UTC")
    kinds = edf.kinds_of(recording, p, 0.5)
    assert edf.differences(recording, done.path, p, kinds).count() == 0
    with open(done.path, "r+b") as f:
        for record, place in ((0, 3), (2, 9)):
            f.seek(p.header_bytes + record * p.record_bytes + 2 * (p.grid.points + place))
            code = int.from_bytes(f.read(2), "little", signed=True)
            f.seek(-2, os.SEEK_CUR)
            f.write((code - 500 if code > 0 else code + 500).to_bytes(2, "little", signed=True))
    found = edf.differences(recording, done.path, p, kinds).collect()
    assert sorted((r["record"], r["signal"], r["place"], r["source"]) for r in found) == [(0, 1, 3, 3 - 100), (2, 1, 9, 128 + p.grid.points + 9 - 100)]


def test_all_276_channels_with_the_auxiliary_ones(spark, folder):
    n, rng = 640, np.random.default_rng(1)
    data = rng.integers(-2000, 2000, (n, 276))
    for channel, only in ONLY_COUNT.items():
        data[:, channel] = only
    names = [f"c{i}" for i in range(276)]
    rows = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(data)], "s long, " + ", ".join(f"{c} long" for c in names))
    synth.write(rows, f"file://{folder}/rec/wide", sample="s", values=names, n_samples=n, rate=512.0, n_channels=276, segment=320, anchors=[(1000, 132 * 10**15), (1000 + n - 1, 132 * 10**15 + (n - 1) * 19531)])
    wide = Recording.open(spark, f"file://{folder}/rec/wide")
    chosen = [1, 2, 249, 255, 272, 273, 274, 275]
    done = export(wide, folder, channels=chosen)
    assert [c for c, _, _ in done.channels] == chosen and done.shorted_channels == () and done.max_error <= 0.5
    p = plan(wide, timezone="UTC", channels=chosen)
    assert edf.differences(wide, done.path, p, edf.kinds_of(wide, p, 0.5)).count() == 0
    file = edf.EdfFile.open(spark, done.path)
    codes = {}
    for r in file.codes().orderBy("record").collect():
        codes.setdefault(r["signal"], []).extend(r["codes"])
    for i, c in enumerate(chosen):
        low, high, dmin, dmax = (float(x) for x in file.signals[i][3:7])
        physical = (np.array(codes[i][:n]) - dmin) / (dmax - dmin) * (high - low) + low
        if c < 256:
            assert np.corrcoef(physical, -data[:, c])[0, 1] > 0.999999
        else:
            assert len(set(physical)) == (1 if c in ONLY_COUNT else len(set(data[:, c])))
