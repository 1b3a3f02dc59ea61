"""A worker holds a tokenizer only from one task that encodes to the next: Spark keeps workers from stage to stage."""

import pandas as pd
import pyarrow as pa
import pytest

from sparkwave.llm import common, tokenize, toxicity
from sparkwave.llm.op10_token_ids import tokenizer_file


@pytest.fixture
def held():
    tokenize.tokenizer.cache_clear()
    tokenize.tokenizer(tokenizer_file())
    yield lambda: tokenize.tokenizer.cache_info().currsize
    tokenize.tokenizer.cache_clear()


def test_other_tasks_drop_it(held):
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    assert [b.num_rows for b in common.tidy(lambda batches: batches, keep=True)(iter([batch]))] == [1] and held() == 1
    assert [b.num_rows for b in common.tidy(lambda batches: batches)(iter([batch]))] == [1] and held() == 0


def test_scoring_drops_it(spark, monkeypatch, held):
    made = []
    monkeypatch.setattr(toxicity.F, "pandas_udf", lambda kind: lambda run: made.append(run) or (_ for _ in ()).throw(KeyError))
    with pytest.raises(KeyError):
        toxicity.scored(spark.createDataFrame([("a",)], "text string"), None)
    assert list(made[0](iter([pd.Series([], dtype=str)])))[0].empty and held() == 0
