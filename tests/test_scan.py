"""Two-level scans against one window, and interval joins of all lengths against brute force."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkwave.operators import ranges, scan


@pytest.fixture
def hot(spark):
    """Key 0 with most of the rows, a null key, repeated orders; few rows a slice."""
    rng = random.Random(1)
    rows = [(i, rng.choice([0] * 9 + [1, None]), rng.randrange(400), rng.randrange(-9, 9), rng.choice([None] * 30 + [5])) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.createDataFrame(rows, "id long, k int, at long, delta long, absolute long").repartition(5)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_a_key_with_most_rows_lies_in_many_slices(hot):
    placed = scan.sliced(hot, ["k"], ["at", "id"])
    sizes = {r["_slice"]: r["count"] for r in placed.where("k = 0").groupBy("_slice").count().collect()}
    assert len(sizes) >= 6 and max(sizes.values()) < 1000


def test_sums_and_last_values_equal_one_window(hot):
    order = Window.partitionBy("k").orderBy("at", "id")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    wanted = hot.withColumn("s", F.coalesce(F.sum("delta").over(before), F.lit(0)))
    assert rows_of(scan.running_sums(hot, ["k"], ["at", "id"], {"s": F.col("delta")}), "id", "s") == rows_of(wanted, "id", "s")
    wanted = hot.withColumn("absolute", F.last("absolute", ignorenulls=True).over(upto))
    assert rows_of(scan.last_values(hot, ["k"], ["at", "id"], "absolute"), "id", "absolute") == rows_of(wanted, "id", "absolute")
    unique = hot.withColumn("at", F.col("at") * 10_000 + F.col("id"))
    both = [ranges.carried(unique, ["k"], "at", "delta", "absolute", "v", bounded=b) for b in (True, False)]
    assert rows_of(both[0], "id", "v") == rows_of(both[1], "id", "v")


def test_as_of_of_a_hot_key(spark, hot):
    right = hot.where("id % 3 = 0").groupBy("k", "at").agg(F.max("id").alias("found"))
    left = hot.select("id", "k", F.when(F.col("id") % 50 != 0, F.col("at")).alias("at"))
    found = {r["id"]: r["found"] for r in ranges.as_of(left, right, ["k"], "at", ["found"]).collect()}
    known = [tuple(r) for r in right.collect()]
    for r in left.collect():
        at = [(a, f) for k, a, f in known if k == r["k"] and r["at"] is not None and a <= r["at"]]
        assert found[r["id"]] == (max(at)[1] if at else None)
    assert ranges.as_of(left.where("false"), right, ["k"], "at", ["found"]).count() == 0
    assert {r["found"] for r in ranges.as_of(left, right.where("false"), ["k"], "at", ["found"]).collect()} == {None}


def test_intervals_of_any_length(spark):
    rng = random.Random(2)
    span = lambda: (a := rng.randrange(-(10**9), 10**9), a + int(10 ** rng.uniform(0, 9)) - 1)
    left = [(i, *span()) for i in range(150)] + [(150, 0, 3 * 10**9), (151, 5, 5), (152, 5, 6), (153, 5, 6)]
    right = [(i, *span()) for i in range(150)] + [(150, 5, 6), (151, 6, 7), (152, -(10**9), 10**9)]
    one, two = spark.createDataFrame(left, "l long, lo long, hi long"), spark.createDataFrame(right, "r long, start long, stop long")
    wanted = sorted((x[0], y[0]) for x in left for y in right if x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    for width in (1, 7, 64):
        met = ranges.interval_join(one, two, [], width)
        assert sorted((r["l"], r["r"]) for r in met.collect()) == wanted


def test_a_long_interval_makes_few_rows(spark):
    """Counted in the plan: rows that enter the join."""
    one = spark.createDataFrame([(0, 3 * 10**9)], "lo long, hi long")
    two = spark.createDataFrame([(1, 2)], "start long, stop long")
    met = ranges.interval_join(one, two, [], 256)
    assert met.count() == 1
    sides = met.queryExecution if hasattr(met, "queryExecution") else met._jdf.queryExecution()
    plan = sides.executedPlan().toString()
    assert "Join" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
