"""Scoring does no Python call a word, and words are counted alike however a text is cut."""

import sys
from collections import Counter

import numpy as np
import pytest

from sparkwave.llm import toxicity


def test_calls_do_not_grow_with_words():
    index = toxicity.build_index([(f"w{i}", 1.0) for i in range(40)], [(i % 2, {f"w{j}": 1 for j in range(i, i + 20)}) for i in range(20)])
    model = toxicity.Model(index, np.ones((40, 2)), np.array([10.0, 20.0]), 2.0, np.array([[0.0, 0.0], [1.0, 1.0]]), np.zeros(3), np.array([-np.inf]), np.array([0.5]), 0.0, list(range(20)))

    def calls(n):
        seen, text = Counter(), " ".join(f"w{i}" for i in range(n))
        sys.setprofile(lambda frame, event, arg: seen.update([event]))
        try:
            model.score(text)
        finally:
            sys.setprofile(None)
        return seen["call"]

    assert calls(5000) < calls(50) + 100


@pytest.mark.parametrize("part", [1, 2, 3, 7, 1 << 16])
def test_no_word_is_cut(monkeypatch, part):
    monkeypatch.setattr(toxicity, "PART", part, raising=False)
    for text in ("", " ", "a", "One two,two  THREE_three ünï ß ÄB́c 12a 12a", "x" * 20, "  , ab", "İstanbul İ"):
        assert toxicity.word_counts(text) == Counter(m[0] for m in toxicity._WORD.finditer(text.lower()))


def test_a_query_takes_a_terms_postings_at_once(monkeypatch):
    index = toxicity.build_index([(f"w{i}", 1.0) for i in range(40)], [(i % 2, {f"w{j}": 1 for j in range(i, i + 20)}) for i in range(20)])
    ids, weights = index.vector({i: 1 for i in range(40)})
    calls, real = [], np.concatenate
    monkeypatch.setattr(np, "concatenate", lambda *a, **k: calls.append(1) or real(*a, **k))
    best, cosines = index.nearest(ids, weights, 3)
    assert len(calls) == 1 and len(best) == 3 and (np.diff(cosines) <= 0).all()
