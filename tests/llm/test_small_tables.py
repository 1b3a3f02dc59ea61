"""On a small table dealt to many tasks, what each task and each query costs by itself counts, not its rows."""

import gc
import time

import pyarrow as pa

from sparkwave.llm import common, components, jaccard_join

from .test_driver import queries

PAIRS = [(0, b) for b in range(1, 40)] + [(50, 51)]


def forms(spark, docs):
    return spark.createDataFrame([(d, 1, bytes([d])) for d in docs], "doc long, n long, form binary")


def test_pairs_are_compared_in_one_query(spark, monkeypatch):
    """Groups of five b's; documents 0 and 7 come with two sets each, and each pair that holds comes once."""
    monkeypatch.setattr(jaccard_join, "GROUP", 5)
    pairs = spark.createDataFrame(PAIRS, "a long, b long")
    every = forms(spark, [*range(40), 0, 7, 50, 51])
    before = queries(spark)
    found = jaccard_join.compared(pairs, len(PAIRS), every, lambda n, x, m, y: y[0] % 2 == 1).collect()
    assert queries(spark) - before == 1
    assert sorted(map(tuple, found)) == [p for p in PAIRS if p[1] % 2]
    monkeypatch.setattr(jaccard_join, "MAX_BROADCAST_BYTES", 0)  # all is shuffled: the same pairs
    found = jaccard_join.compared(pairs, len(PAIRS), every, lambda n, x, m, y: y[0] % 2 == 1).collect()
    assert sorted(map(tuple, found)) == [p for p in PAIRS if p[1] % 2]


def test_stars_take_no_round(spark, monkeypatch):
    monkeypatch.setattr(components, "MAX_ROUNDS", 1)
    stars = spark.createDataFrame([(100, 100 + i) for i in range(1, 50)] + [(7, 3), (3, 5)], "a long, b long")
    assert {r["doc"]: r["component"] for r in components.components(stars).collect()} == {100 + i: 100 for i in range(50)} | {3: 3, 5: 3, 7: 3}


def test_only_stars_end_the_rounds(spark):
    links = lambda *rows: components._are_stars(spark.createDataFrame(rows, "u long, v long"))
    assert links((2, 1), (3, 1), (9, 8))
    assert not links((2, 1), (3, 2))  # a path
    assert not links((3, 1), (3, 2))  # two centres


def test_tasks_look_for_cycles_only_in_what_they_made():
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    run = common.tidy(lambda batches: batches)
    try:
        common.set_aside.cache_clear()
        loaded = [[i] for i in range(3_000_000)]  # as modules are, before the first task
        list(run(iter([batch])))
        began = time.thread_time()
        list(run(iter([batch])))
        assert time.thread_time() - began < 0.1
        assert len(loaded) == 3_000_000
    finally:
        gc.unfreeze()
        common.set_aside.cache_clear()
