"""N-gram Jaccard join against brute force."""

import re
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwave.llm import jaccard_join
from sparkwave.llm.components import components


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    ids = [i for i, _ in rows]
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((top(ids[a]), top(ids[b])))
            root[y] = x
    return sorted((i, len(s), top(i)) for i, s in zip(ids, sets, strict=True))


def test_equals_brute_force(spark, documents):
    rng = np.random.default_rng(5)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    for g in range(12):
        words = [f"g{g}v{k}" for k in rng.integers(0, 10**6, rng.integers(20, 200))]
        for c in range(6):
            copy = list(words)
            for at in rng.integers(0, len(copy), rng.integers(0, max(2, len(copy) // 24))):
                copy[at] = f"new{rng.integers(10**6)}"
            rows.append((100 + 10 * g + c, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.join(docs, "doc_id", "text").collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute(rows)


def test_one_of_each_group_stays_and_columns_too(spark, documents):
    kept = jaccard_join.deduplicate(documents.where("doc_id <> 6 and doc_id <> 7"), "doc_id", "text")
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 3, 8, 10, 11, 12, 14]


def test_empty_table(spark, documents):
    assert jaccard_join.join(documents.where("false"), "doc_id", "text").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**63), min_size=1, max_size=300), st.sets(st.integers(0, 2**63), max_size=60), st.integers(0, 60))
def test_bitmaps_never_refuse_a_link(common, more, cut):
    a = np.sort(np.array(sorted(common), dtype=np.uint64))
    b = np.sort(np.array(sorted((set(sorted(common)[cut:]) | more) or {1}), dtype=np.uint64))
    if jaccard_join._do_link(len(a), a.tobytes(), len(b), b.tobytes()):
        assert jaccard_join._may_link(len(a), jaccard_join._bitmap(a), len(b), jaccard_join._bitmap(b))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["doc"], r["component"]) for r in found} == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(50)}


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 700), st.floats(0, 1), st.floats(0, 1), st.integers(0, 2**32))
def test_linked_sets_share_a_key_by_position(n, changed, frequent, seed):
    """Whatever tokens are frequent; half the time, few enough tokens to crowd segments."""
    rng = np.random.default_rng(seed)
    draw = lambda k: rng.integers(0, 2**63, k).astype(np.uint64)
    x = np.unique(draw(n))
    most = int(len(x) * 2 // 7 * changed)
    lost = rng.integers(0, most + 1)
    y = np.unique(np.concatenate([rng.permutation(x)[: len(x) - lost], draw(most - lost)]))
    both = len(np.intersect1d(x, y))
    if not jaccard_join.linked(both, len(x), len(y)):
        return
    every = np.union1d(x, y)
    class_of = np.where(rng.random(len(every)) < frequent * rng.random(), rng.integers(1, 9, len(every)), 0).astype(np.uint8)
    met = False
    for upper in set(jaccard_join.schemes(len(x))) & set(jaccard_join.schemes(len(y))):
        (k, i), (m, j) = (jaccard_join.keys_of(s, jaccard_join._classes(s, every, class_of), upper) for s in (x, y))
        _, a, b = np.intersect1d(k, m, return_indices=True)
        met = met or bool(jaccard_join._may_meet(len(x), len(y), i[a], j[b]).any())
    assert met


def test_crowded_segments_fall_back_to_tokens(monkeypatch):
    """Sets whose segments carry too few differences meet in single tokens, and with others in segments."""
    rng = np.random.default_rng(11)
    for segments, deletion, of_subset in ((9, True, 10), (40, True, 48), (9, True, 48), (12, False, 12)):
        monkeypatch.setattr(jaccard_join, "allocate", lambda upper, form=(segments, deletion): form)
        monkeypatch.setattr(jaccard_join, "subset_segments", lambda upper, count=of_subset: count)
        for _ in range(200):
            x = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
            y = np.unique(np.concatenate([x[8:], rng.integers(0, 2**63, 8).astype(np.uint64)]))
            classes = (rng.random(len(np.union1d(x, y))) < 0.1).astype(np.uint8)
            every = np.union1d(x, y)
            (k, i), (m, j) = (jaccard_join.keys_of(s, jaccard_join._classes(s, every, classes), 64) for s in (x, y))
            _, a, b = np.intersect1d(k, m, return_indices=True)
            assert jaccard_join._may_meet(len(x), len(y), i[a], j[b]).any()


def test_long_lists_in_blocks(spark, monkeypatch):
    """A chain of copies that drift, of a passage that many share, compared in several blocks of a list."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base, rows = [f"b{k}" for k in range(90)], []
    for i in range(120):
        own = list(base)
        for at in rng.choice(90, rng.integers(0, 6), replace=False):
            own[at] = f"n{rng.integers(10**6)}"
        rows.append((i, " ".join(own + [f"t{i}x{k}" for k in range(rng.integers(0, 12))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.join(docs, "doc_id", "text").collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute(rows)


def test_null_keys_have_no_component(spark):
    text = "a b c d e f g h i j k"
    found = jaccard_join.join(spark.createDataFrame([(None, text), (1, text), (2, text)], "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in found) == [(0, None), (1, 1), (2, 1)]
