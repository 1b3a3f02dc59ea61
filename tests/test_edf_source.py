"""EDF+ as a data source: rows against the plain reader, filters, both layouts, and writes that fail and leave nothing."""

import copy
import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from sparkwave.errors import DataIntegrityError, UnsupportedFormatError
from sparkwave.sources import edf, edf_source, synth
from sparkwave.sources.edf_store import MANIFEST, Head, Stored
from sparkwave.sources.recording import Recording

ANCHORS = [(1000, 132 * 10**15), (1319, 132 * 10**15 + 319 * 19531)]


@pytest.fixture(scope="module")
def made(spark):
    folder = tempfile.mkdtemp(prefix="spark-edfsource-")
    rows = spark.createDataFrame([(s, 1500 + s * 7 % 257 * 2, s - 100) for s in range(320) if not 64 <= s < 128], "s long, a long, b long")
    synth.write(rows, f"file://{folder}/rec", sample="s", values=["a", "b"], n_samples=320, rate=512.0, n_channels=3, packet=32, segment=160, anchors=ANCHORS, notes=[synth.event_note(1010, "marker", "me")])
    recording = Recording.open(spark, f"file://{folder}/rec", channels=None)
    path = edf.export(recording, f"{folder}/one.edf", timezone="UTC").path
    edf_source.export(recording, f"file://{folder}/parts.edf", timezone="UTC")
    yield recording, path, f"file://{folder}/parts.edf"
    shutil.rmtree(folder)


@pytest.fixture
def out():
    folder = tempfile.mkdtemp(prefix="spark-edfout-")
    yield folder
    shutil.rmtree(folder)


def loaded(spark, uri, **options):
    return spark.read.format("edf").options(**options).load(uri)


@pytest.mark.parametrize("condition", ["true", "record = 2", "record > 0 and record <= 2", "signal = 1 and record < 3", "signal in (0, 2, 9)", "signal in (0) and signal = 1", "record >= 9", "record < 0", "record > 2 and record < 1", "code > 100 and record between 1 and 2", "record = 1 or signal = 0", "record is not null and place = 7", "signal is null", "record = -1 and record < 5", "record in (1, 3)", "signal <> 0"])
def test_conditions_give_what_spark_would(spark, made, condition):
    _, path, parts = made
    order = ["record", "signal", "place"]
    every = spark.createDataFrame(edf.EdfFile.open(spark, path).values().collect(), edf_source.SCHEMAS["values"])
    wanted = every.where(condition).orderBy(order).collect()
    for uri in (path, f"file://{path}", parts):
        assert loaded(spark, uri, filters="true").where(condition).orderBy(order).collect() == wanted


def test_filters_reach_the_source(spark, made):
    plan = loaded(spark, made[2], filters="true").where("record = 2 and signal = 0")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "BatchScan edf" in plan, plan
    reader = edf_source.FilteredReader({"path": made[2]})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(reader.pushFilters([EqualTo(("record",), 2), EqualTo(("signal",), 0), GreaterThan(("code",), 5)])) == [GreaterThan(("code",), 5)]
    assert reader.partitions() == [edf_source.Run(2, 1)] and reader.chosen.signals == {0}


def test_options_and_one_load_with_many_conditions(spark, made):
    rows = loaded(spark, made[2])
    assert rows.where("record = 1").union(rows.where("record = 2 and signal = 0")).count() == rows.count() // 4 + rows.count() // 12
    narrowed = loaded(spark, made[2], first=1, stop=3, signals="1,0")
    assert sorted(narrowed.collect()) == sorted(rows.where("record in (1, 2) and signal in (0, 1)").collect())
    assert loaded(spark, made[2], first=9).count() == loaded(spark, made[2], stop=0).count() == loaded(spark, made[2], signals="7").count() == 0


def test_other_rows_and_joined_parts_are_the_file(spark, made):
    _, path, parts = made
    file, order = edf.EdfFile.open(spark, path), ["record", "signal"]
    assert loaded(spark, parts, rows="codes").orderBy(order).collect() == file.codes().orderBy(order).collect()
    order = ["record", "ordinal"]
    assert loaded(spark, parts, rows="annotations").orderBy(order).collect() == file.annotations().orderBy(order).collect()
    stored = Stored.open(parts)
    with open(path, "rb") as f, stored.reader() as read:
        assert stored.head.data + read(0, stored.head.records) == f.read()
    assert edf.EdfFile.open(spark, parts).values().count() == file.values().count()
    with pytest.raises(Exception, match="rows must be"):
        loaded(spark, parts, rows="lines").schema


@pytest.mark.parametrize("layout", ["parts", "file"])
def test_rows_in_any_order_and_split_over_tasks(spark, made, out, layout):
    head = Stored.open(made[1]).head
    records = loaded(spark, made[1], rows="records")
    records.orderBy(F.col("record").desc()).repartition(3).write.format("edf").options(header=head.data.decode(), layout=layout).mode("append").save(f"file://{out}/x.edf")
    order = ["record"]
    assert loaded(spark, f"file://{out}/x.edf", rows="records").orderBy(order).collect() == records.orderBy(order).collect()
    assert os.listdir(out) == ["x.edf"]


def refused(spark, records, header, out, layout, match, name="x.edf", mode="append"):
    before = sorted(os.listdir(out))
    with pytest.raises(Exception, match=match):
        records.write.format("edf").options(header=header, layout=layout).mode(mode).save(f"file://{out}/{name}")
    assert sorted(os.listdir(out)) == before


@pytest.mark.parametrize("layout", ["parts", "file"])
def test_writes_that_fail_leave_nothing(spark, made, out, layout):
    header = Stored.open(made[1]).head.data.decode()
    records = loaded(spark, made[1], rows="records").repartition(2, "record")
    refused(spark, records.where("record <> 2"), header, out, layout, "record 2 was written by no task")
    refused(spark, records.where("record < 3"), header, out, layout, "record 3 was written by no task")
    refused(spark, records.union(records.where("record = 1")), header, out, layout, "record 1 was written twice")
    refused(spark, records.withColumn("payload", F.when(F.col("record") == 3, F.lit(b"x")).otherwise(F.col("payload"))), header, out, layout, "doesn't fit")
    refused(spark, records.withColumn("payload", F.when(F.col("record") != 3, F.col("payload"))), header, out, layout, "doesn't fit")
    refused(spark, records.withColumn("record", F.col("record") + F.raise_error(F.lit("lost")).cast("int")), header, out, layout, "lost")
    refused(spark, records.limit(0), header, out, layout, "record 0 was written by no task")
    refused(spark, records, header[:-1], out, layout, "isn't the header")
    refused(spark, records, header, out, layout, "never replaced", mode="overwrite")
    refused(spark, records.withColumn("more", F.lit(1)), header, out, layout, "rows must be")
    refused(spark, records, header, out, "lines", "layout must be")
    with open(f"{out}/taken.edf", "wb") as f:
        f.write(b"mine")
    os.symlink("nowhere", f"{out}/link.edf")
    for name in ("taken.edf", "link.edf"):
        refused(spark, records, header, out, layout, "taken|link", name)
    with open(f"{out}/taken.edf", "rb") as f:
        assert f.read() == b"mine"


@pytest.mark.parametrize("layout", ["parts", "file"])
def test_a_name_taken_meanwhile_stays(made, out, layout):
    """The commit of two writers of one name: the second is refused, and its abort leaves the first one's file."""
    stored = Stored.open(made[1])
    options = {"path": f"file://{out}/x.edf", "header": stored.head.data.decode(), "layout": layout}
    one = edf_source.EdfWriter(options, ["record", "payload"], False)
    if layout == "parts":
        with pytest.raises(FileExistsError):
            edf_source.EdfWriter(options, ["record", "payload"], False)
        two = copy.copy(one)  # as where making a folder doesn't refuse one that is there
        two.token = "other"
    else:
        two = edf_source.EdfWriter(options, ["record", "payload"], False)
    width, n = stored.head.record_bytes, stored.head.records
    with stored.reader() as read:
        data = read(0, n)
    messages = []
    for w in (one, two):
        rows = ((i, data[i * width : (i + 1) * width]) for i in range(n))
        if layout == "file":
            messages.append(edf_source.Written(w.into_place(rows)))
        else:
            with open(f"{out}/x.edf/all.{w.token}", "wb") as f:
                f.write(data)
            with open(f"{out}/x.edf/lost.{w.token}", "wb") as f:
                f.write(data[:5])
            messages.append(edf_source.Written([(0, n, f"all.{w.token}")]))
    one.commit([messages[0], None])
    with pytest.raises(FileExistsError):
        two.commit([messages[1]])
    two.abort([messages[1]])
    assert os.listdir(out) == ["x.edf"]
    if layout == "parts":
        assert sorted(os.listdir(f"{out}/x.edf")) == sorted([MANIFEST, f"all.{one.token}"])
    kept = Stored.open(f"{out}/x.edf")
    with kept.reader() as read:
        assert read(0, n) == data and read(2, 1) == data[2 * width : 3 * width]
        with pytest.raises(DataIntegrityError):
            read(n - 1, 2)


def test_an_export_that_isn_t_right_goes(spark, made, monkeypatch):
    recording, folder = made[0], os.path.dirname(made[1])
    before = sorted(os.listdir(folder))

    def wrong(*_):
        raise DataIntegrityError("codes differ")

    with monkeypatch.context() as m:
        m.setattr(edf, "verify", wrong)
        with pytest.raises(DataIntegrityError, match="codes differ"):
            edf_source.export(recording, f"file://{folder}/x.edf", timezone="UTC")
    with monkeypatch.context() as m:
        real = edf.verify
        m.setattr(edf, "verify", lambda *a: (real(*a), os.utime(f"{folder}/rec/rec.snc", (1, 5))))
        with pytest.raises(DataIntegrityError, match="changed"):
            edf_source.export(recording, f"file://{folder}/x.edf", timezone="UTC")
    with pytest.raises(FileExistsError):
        edf_source.export(recording, made[2], timezone="UTC")
    assert sorted(os.listdir(folder)) == before


def test_damaged_files_are_refused(spark, made, out):
    with open(made[1], "rb") as f:
        data = f.read()
    for name, content, error in (("short", data[:-1], DataIntegrityError), ("long", data + b"x", DataIntegrityError), ("empty", b"", UnsupportedFormatError), ("text", b"a" * 600, UnsupportedFormatError), ("open", data[:236] + b"-1      " + data[244:], UnsupportedFormatError)):
        with open(f"{out}/{name}.edf", "wb") as f:
            f.write(content)
        with pytest.raises(error):
            Stored.open(f"{out}/{name}.edf")
    shutil.copytree(made[2].removeprefix("file://"), f"{out}/parts.edf")
    part = next(n for n in os.listdir(f"{out}/parts.edf") if n.startswith("records"))
    os.truncate(f"{out}/parts.edf/{part}", 10)
    with pytest.raises(Exception, match="shorter"):
        loaded(spark, f"{out}/parts.edf").collect()
    os.unlink(f"{out}/parts.edf/{MANIFEST}")
    with pytest.raises(FileNotFoundError):
        Stored.open(f"{out}/parts.edf")
    assert Head(data[: len(Stored.open(made[1]).head.data)]).records == 4
