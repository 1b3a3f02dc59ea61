"""Logical samples with gaps as nulls: what is stored goes into no join, whose side Spark may take for small and broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from sparkwave import queries
from sparkwave.operators import coverage, ranges
from sparkwave.session import scratch_dir
from sparkwave.sources import synth
from sparkwave.sources.recording import Recording

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["gap_fill", "chunk_counts", "missing_by_channel"])
def test_samples_are_joined_with_nothing(spark, name):
    found = queries.QUERIES[name](spark, SF)
    found.collect()
    assert not re.search(r"Join \[sample#", found._jdf.queryExecution().executedPlan().toString())


def test_gaps_longer_than_a_piece_and_a_shorted_channel(spark):
    n, piece = 30_000, ranges.PIECE
    kept = [*range(piece - 1, piece + 2), *range(3 * piece, 3 * piece + 70), n - 2]
    rows = spark.createDataFrame([(s, s * 7, -s) for s in kept], "s long, a long, b long")
    r = Recording.open(spark, synth.write(rows, scratch_dir(spark, "gaps"), sample="s", values=["a", "b"], n_samples=n, rate=512.0, n_channels=3, packet=32, segment=5000), channels=None)
    found = coverage.filled_samples(r).toPandas()
    assert len(found) == 3 * n and not found.duplicated(["sample", "channel"]).any() and found["sample"].between(0, n - 1).all()
    stored = found[found["value"].notna()]
    assert {(s, c): v for s, c, v in stored.itertuples(index=False)} == {(s, c): v for s in kept for c, v in ((0, s * 7), (1, -s))}


def test_a_recording_without_samples_is_all_null(spark):
    none = spark.createDataFrame([], "s long, a long")
    r = Recording.open(spark, synth.write(none, scratch_dir(spark, "none"), sample="s", values=["a"], n_samples=100, rate=512.0, n_channels=1, packet=32, segment=64), channels=None)
    row = coverage.filled_samples(r).agg(F.count("*").alias("n"), F.countDistinct("sample").alias("samples"), F.count("value").alias("values")).first()
    assert (row["n"], row["samples"], row["values"]) == (100, 100, 0)


@pytest.mark.parametrize("name", ["chunk_counts", "missing_by_channel"])
def test_counting_makes_no_row_of_each_sample(spark, name):
    found = queries.QUERIES[name](spark, SF)
    found.collect()
    assert not re.search(r"explode\(values#", found._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("size", [1, 7, 480, 5000, 40_000])
def test_counts_equal_those_of_the_rows(spark, size):
    n, piece = 9000, ranges.PIECE
    kept = [*range(piece - 1, piece + 2), *range(2 * piece, 2 * piece + 70), n - 2]
    rows = spark.createDataFrame([(s, s * 7, -s) for s in kept], "s long, a long, b long")
    r = Recording.open(spark, synth.write(rows, scratch_dir(spark, "counts"), sample="s", values=["a", "b"], n_samples=n, rate=512.0, n_channels=3, packet=32, segment=5000), channels=None)
    cells = coverage.filled_samples(r).toPandas()
    cells["chunk"], cells["null"] = cells["sample"] // size, cells["value"].isna()
    wanted = {(c, k): (len(g) - g["null"].sum(), g["null"].sum()) for (c, k), g in cells.groupby(["chunk", "channel"])}
    assert {(c, k): (a, b) for c, k, a, b in coverage.chunk_counts(r, size).toPandas().itertuples(index=False)} == wanted
    of = {k: (len(g) - g["null"].sum(), g["null"].sum()) for k, g in cells.groupby("channel")}
    assert {k: (a, b) for k, a, b in coverage.channel_counts(r).toPandas().itertuples(index=False)} == of
