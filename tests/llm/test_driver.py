"""What the driver holds: a query leaves plans, tasks and metrics in its memory, a model's examples are numbers."""

import tracemalloc

import numpy as np

from sparkwave.llm import components, jaccard_join, toxicity


def queries(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_a_round_of_components_is_one_query(spark):
    edges = spark.createDataFrame([(100, 100 + i) for i in range(1, 50)], "a long, b long")
    before = queries(spark)
    assert components.components(edges).count() == 50
    assert queries(spark) - before <= 4  # a table of links, one round, the components, and the count


def test_components_without_edges(spark):
    none = spark.createDataFrame([(7, 7), (None, 3)], "a long, b long")
    assert components.components(none).count() == 0
    within = spark.createDataFrame([(1, 0), (0, 0)], "doc long, component long")
    assert sorted(map(tuple, components.merged(within, none).collect())) == [(0, 0), (1, 0)]


def test_rows_to_broadcast_are_counted_as_they_are_written(spark, monkeypatch):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(jaccard_join, "MAX_BROADCAST_BYTES", 80)
    before = queries(spark)
    assert [hinted(jaccard_join._small(spark.range(n), "rows", 8)) for n in (0, 10, 11)] == [True, True, False]
    assert queries(spark) - before == 3


def test_examples_take_little_memory_while_a_model_is_fitted(spark):
    rng = np.random.default_rng(12)
    bank = [f"word{i}" for i in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(bank, 400))) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    tracemalloc.start()
    try:
        model = toxicity.fit(docs, labels)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    print("bytes for a posting:", most / len(model.index.postings))
    assert most < 100 * len(model.index.postings)
