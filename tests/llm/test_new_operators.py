"""Hard negatives, conversation repair and mixing against brute force."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkwave.llm import conversation_repair as repair
from sparkwave.llm import hard_negatives, mixing, op11_hard_negatives, op12_conversation_repair, op13_mixing

VECTORS = "vec_id long, embedding array<float>, label int, key int, anchor int"


def mined(rows):
    """By plain loops; rows are (vec_id, embedding, label)."""
    good = []
    for n, (i, v, y) in enumerate(rows):
        if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.append((n, i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i % 7 == 0 else y))
    out = []
    for n, i, v, y in good:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for m, j, w, z in good if m != n and len(w) == len(v))
        for p, j in [(-s, j) for s, j, z in scored if z == y][:5]:
            found = [(-s, k) for s, k, z in scored if z != y and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(i, j, r + 1, k, p, s) for r, (s, k) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 0.75, 1.5]) for _ in range(4)], rng.randrange(4)) for i in range(-100, 500)]
    rows += [(50, [0.5, 0.5, 0.5, 0.5], 1)] * 40 + [(i, [1.0, 1.0, 1.0, 1.0], 2) for i in range(1000, 1060)]
    return rows + [(None, [1.0] * 4, 1), (600, None, 1), (650, [1.0] * 4, None), (700, [1.0, None, 1.0, 1.0], 1), (750, [1.0, float("nan"), 1.0, 1.0], 1), (800, [float("inf")] * 4, 1), (850, [], 1), (900, [1.0, 2.0], 1), (901, [1.0, 2.0], 1), (902, [1.0, 1.5], 2)]


def test_hard_negatives_equal_brute_force(spark, folder_of, vectors, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 100)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    folder = folder_of(embeddings=spark.createDataFrame([(*r, 1, 2) for r in vectors], VECTORS))
    found = op11_hard_negatives.op11_hard_negatives(spark, folder)
    columns = "anchor_id positive_id rank negative_id positive_score negative_score".split()
    assert sorted(map(tuple, found.select(*columns).collect())) == mined(vectors)


def test_hard_negatives_of_an_empty_table_and_of_large_numbers(spark, folder_of):
    rows = [(i, [1e5 * (i + 1), -3e5], i % 2) for i in (0, 1, 2, 3, 50)]
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(empty, F.col("vec_id") == 0, key="vec_id", vector="embedding", label="label").count() == 0
    found = op11_hard_negatives.op11_hard_negatives(spark, folder_of(embeddings=spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS)))
    assert sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == mined(rows)


def cheapest(rows):
    """(cost, audit) of rows (initial, fault) by a search over all edits in order of cost and string."""
    keep, after = repair.KEEP, repair.NEXT
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit
        if (i, state, audit) in seen or len(audit) > 2 * len(rows) + 2:
            continue
        seen.add((i, state, audit))
        heapq.heappush(heap, (cost + 5, audit + "I", i, after[state]))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, after[state]))
                if initial in keep[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, keep[state][initial]))


def chained(signature, size):
    chain = repair.Chain()
    for i in range(0, len(signature), size):
        part = signature[i : i + size]
        table = [x for row in repair.solve(part) for x in row]
        chain.add(part, repair.illegal_pairs(repair.initials(part)), [x and x[0] for x in table], [x and x[1] for x in table])
    return chain.result()


def test_all_short_signatures_have_the_cheapest_edits_however_they_are_cut():
    letters = [(c, None) for c in "suax"] + [(c, "truncated") for c in "suax"] + [("u", "blank")]
    marks = dict(zip(letters, repair.SOUND + repair.CUT + "2", strict=True))
    rng = random.Random(4)
    every = [list(x) for n in (1, 2, 3) for x in itertools.product(letters, repeat=n)] + [[rng.choice(letters) for _ in range(rng.randrange(4, 7))] for _ in range(150)]
    for rows in every:
        signature = "".join(marks[r] for r in rows)
        wanted = cheapest(rows)
        for size in (1, 2, 3, 100):
            illegal, *found = chained(signature, size)
            assert tuple(found) == wanted and illegal == repair.illegal_pairs("".join(c for c, _ in rows)), signature


def repaired_by_hand(rows):
    """The contract's columns by plain Python; rows are (conv_id, turn, role, text)."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        groups[conv] += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = []
    for conv, given in groups.items():
        given.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, marked, faults = set(), [], Counter()
        for _, role, text in given:
            words = re.sub(r"[\x20\x09-\x0d]+", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault))
        turns = {t for t, _, _ in given if t is not None}
        cost, audit = cheapest(marked)
        state, lines, rest = 0, [], iter(given)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rest)[1:]
            if edit != "D":
                state = repair.KEEP[state][role[0]] if edit == "K" else repair.NEXT[state]
                lines.append(f"{role if edit == 'K' else repair.ROLE[state]}:{text}")
        pairs = repair.illegal_pairs("".join(c for c, _ in marked))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part", [3, 128])
def test_repair_equals_brute_force(spark, folder_of, part, monkeypatch):
    rng = random.Random(5)
    texts = ["Yes.", "no", "What? ", " \t\n", "", "ünïcode …", "Fine!\x0b", "line\none.", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(150) for t in range(rng.randrange(1, 7))]
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(30)]  # a long one
    rows += [(2000, 5, "user", "Same.")] * 12 + [(3000, None, r, f"{r}{i}.") for i in range(2) for r in ("user", "assistant")] + [(None, t, "user", "Hm.") for t in (None, 1, 9)]
    rows += [(4000 + i, 0, "user", "Alone.") for i in range(60)]  # some of these lose all their rows
    monkeypatch.setattr(repair, "PART", part)
    folder = folder_of(conversations=spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, conv string").repartition(7))
    found = op12_conversation_repair.op12_conversation_repair(spark, folder)
    columns = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == repaired_by_hand(rows)


def test_repaired_rows_are_real_and_an_empty_table_has_none(spark):
    rows = spark.createDataFrame([("c", 1, "user", "Hi."), ("c", 2, "tool", "Out."), ("c", 4, "user", "Bye."), ("c", 5, "user", "Bye.")], "conv_id string, turn long, role string, text string")
    report, fixed = repair.repair(rows)
    assert [r.asDict() for r in report.select("conv", "gaps", "duplicate", "cost", "audit").collect()] == [{"conv": "c", "gaps": 1, "duplicate": 1, "cost": 5, "audit": "KDRD"}]
    assert [tuple(r) for r in fixed.orderBy("place").collect()] == [("c", 0, "K", 1, "user", "Hi."), ("c", 1, "R", 4, "assistant", "Bye.")]
    report, fixed = repair.repair(rows.where("false"))
    assert report.count() == 0 == fixed.count()


def filled(sizes, weights):
    """Targets by rounds: those above their limit stop there, the excess goes to the others by weight."""
    stopped, total = {}, sum(sizes.values())
    while True:
        left = {s: w for s, w in weights.items() if s not in stopped}
        level = (total - sum(stopped.values())) / sum(left.values()) if left else 0
        above = {s: 3 * sizes[s] for s, w in left.items() if w * level > 3 * sizes[s]}
        if not above:
            return stopped | {s: w * level for s, w in left.items()}
        stopped |= above


def test_mix_equals_brute_force(spark, folder_of, documents):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", "z", None, "none"])) for i in range(600)]
    rows = [(i, None if s == "none" else t, s) for i, t, s in rows] + [(700 + i, "tiny one", f"s{i}") for i in range(8)] + [(3, "again and again", "hot")] * 5 + [(None, "no id", "a")]
    folder = folder_of(documents=spark.createDataFrame([(i, t, "en", s, 1, 2, 3) for i, t, s in rows], documents.schema).repartition(5))
    found = op13_mixing.op13_mixing(spark, folder).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    names = sorted((s for s in sizes if s is not None)) + [None]
    wanted = filled(sizes, {s: i % 3 + 1 for i, s in enumerate(names)})
    assert sum(3 * sizes[s] == wanted[s] and sizes[s] > 0 for s in names) >= 3  # some stop
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in found) == Counter((i, size(t), s) for i, t, s in rows)
    taken, at = Counter(), defaultdict(list)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], wanted[r["source"]], rel_tol=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["epochs"] * r["size"] + r["rest"]
        taken[r["source"]] += r["taken"]
        at[r["source"]].append((hashlib.md5(f"mix:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest(), r["size"], r["rest"]))
    for s in names:
        assert abs(taken[s] - wanted[s]) <= 0.5
        left = taken[s] - sum(r["epochs"] * r["size"] for r in found if r["source"] == s)
        for _, n, rest in sorted(at[s]):  # all before the cut whole, one in part, none after it
            assert rest == min(n, left)
            left -= rest
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, op13_mixing.op13_mixing(spark, folder).collect()), key=repr)


def test_texts_of_a_mix(spark, documents):
    docs = documents.dropDuplicates(["doc_id"])
    mixed = mixing.mix(docs, source="lang", weights=(1,))
    assert {(r["taken"], r["size"]) for r in mixed.collect() if r["taken"] != r["size"]} == set()
    mixed = mixed.withColumns({"epochs": F.lit(1).cast("long"), "rest": F.least("size", F.lit(3).cast("long")), "taken": F.col("size") + F.least("size", F.lit(3).cast("long"))})
    found = {(r["key"], r["epoch"]): r["text"] for r in mixing.mixed_texts(docs, mixed).collect()}
    assert found[9, 1] == "short text" == found[9, 2] and found[3, 2] == "one two three" and found[3, 1].endswith("sixteen") and (0, 1) not in found
    assert mixing.mix(docs.where("false")).count() == 0
