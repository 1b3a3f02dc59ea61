"""Documents of a bucket that many pairs connect go out as one list, not as pairs."""

import numpy as np
import pytest

from sparkwave.llm import jaccard_join


def blob(keys_of: dict[int, list[int]], size: int) -> bytes:
    docs, runs = np.array(list(keys_of), dtype="<i8"), np.array([len(k) for k in keys_of.values()], dtype="<i4")
    keys = np.array([k for ks in keys_of.values() for k in ks], dtype="<u8")
    before = np.concatenate([np.arange(n) for n in runs]).astype("<u2")
    head = np.array([len(docs)], dtype="<i8").tobytes() + docs.tobytes() + docs.tobytes() + np.full(len(docs), size, dtype="<i4").tobytes() + runs.tobytes()
    return head + before.tobytes() + keys.view("u1").reshape(-1, 8)[:, :6].tobytes()


def rows_of(keys_of: dict[int, list[int]]) -> tuple[set, dict]:
    pairs, lists = set(), {}
    for batch in jaccard_join._bucket_rows([blob(keys_of, 300)]):
        for r in batch.to_pylist():
            if r["a"] is not None:
                pairs.add((r["a"], r["b"]))
            else:
                lists.setdefault((r["list"], r["many"]), set()).add(r["doc"])
    return pairs, lists


def test_a_crowd_has_a_row_a_document():
    pairs, lists = rows_of({d: list(range(8)) for d in range(12)})
    assert not pairs and list(lists.values()) == [set(range(12))]
    assert len(lists) == 1


@pytest.mark.parametrize("seed", range(8))
def test_no_pair_with_a_common_key_is_lost(seed):
    rng = np.random.default_rng(seed)
    keys_of = {d: sorted(rng.choice(40 * (seed + 1), 6, replace=False).tolist()) for d in range(60)}
    pairs, lists = rows_of(keys_of)
    given = pairs | {(x, y) for docs in lists.values() for x in docs for y in docs if x < y}
    wanted = {(x, y) for x in keys_of for y in keys_of if x < y and set(keys_of[x]) & set(keys_of[y])}
    assert wanted <= given
    assert all(many == len(docs) for (_, many), docs in lists.items())


def test_a_chain_stays_pairs():
    pairs, lists = rows_of({d: [d, d + 1] for d in range(50)})
    assert not lists and pairs == {(d, d + 1) for d in range(49)}
