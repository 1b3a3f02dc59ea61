"""Rows of buckets stay small however few buckets there are: a thousand of them go to a worker at once."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from sparkwave.llm import jaccard_join


class Mapped:
    """Stands for a DataFrame whose mapped function is run here."""

    def mapInArrow(self, run, schema):  # noqa: N802
        return run

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition  # noqa: N815


def test_rows_of_few_buckets_are_small_and_whole():
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50_000, 400)) for _ in range(300)]
    texts += [f"{t} more" for t in texts[:20]]
    n = len(texts)
    docs = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts), pa.array(range(n)), pa.nulls(n, pa.binary())], names=["doc", "text", "component", "gone"])
    hot = SimpleNamespace(value=(b"", b""))
    rows = [(k, blob) for batch in jaccard_join.keyed(Mapped(), 5, 2, hot)([docs]) for k, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    keys = [len(jaccard_join._read_blob(blob)[0]) for _, blob in rows]
    assert sum(keys) > 50_000 and max(keys) < 3 * 2048
    rows.sort(key=lambda r: r[0])
    parts = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i : i + 7]], pa.int32()), pa.array([b for _, b in rows[i : i + 7]], pa.binary())], names=["bucket", "blob"]) for i in range(0, len(rows), 7)]
    found = {(a, b) for batch in jaccard_join.candidates(Mapped(), 2)(parts) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)}
    assert {(i, 300 + i) for i in range(20)} <= found
