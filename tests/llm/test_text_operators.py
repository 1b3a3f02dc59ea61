"""Decontamination, toxicity, scoring and packing against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkwave.llm import decontaminate, op2_decontamination, op8_toxicity, packing, ppm, token_store, toxicity
from sparkwave.llm.op10_token_ids import tokenizer_file

from .conftest import SF

FILE = tokenizer_file()


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_decontamination_equals_brute_force(spark, documents, folder_of):
    base = documents.where("doc_id = 3").first()["text"]
    items = [("a", base), ("b", "short text"), ("c", None), ("d", "..."), ("e", "Eleven; twelve, thirteen! fourteen fifteen sixteen suffix"), ("b2", "SHORT text")]
    folder = folder_of(documents=documents, benchmark=spark.createDataFrame(items, "item_id string, text string"))
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    wanted = []
    for r in documents.collect():
        w, hit, names = words(r["text"]), set(), set()
        for item, text in items:
            v = words(text)
            for win in {tuple(v[i : i + 13]) for i in range(max(1, len(v) - 12))} - {()}:
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        names.add(item)
        wanted.append((r["doc_id"], len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    found = [tuple(r) for r in op2_decontamination.op2_decontamination(spark, folder).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(found) == sorted(wanted)
    clean = decontaminate.clean_documents(documents, spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert clean.columns == documents.columns and clean.count() == sum(not w[-1] for w in wanted)


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(3)
    vocabulary = [(f"t{i}", float(w)) for i, w in enumerate(rng.uniform(0.5, 4, 40))]
    examples = [(int(rng.random() < 0.4), {f"t{k}": int(n) for k, n in zip(rng.integers(0, 40, 6), rng.integers(1, 5, 6), strict=True)}) for _ in range(500)]
    index = toxicity.build_index(vocabulary, examples)
    vectors = np.zeros((500, 40))
    for i, (_, counts) in enumerate(examples):
        for t, n in counts.items():
            vectors[i, int(t[1:])] = (1 + math.log(n)) * vocabulary[int(t[1:])][1]
        vectors[i] /= np.linalg.norm(vectors[i])
    for _ in range(50):
        ids, w = index.vector({int(k): int(n) for k, n in zip(rng.integers(0, 40, 8), rng.integers(1, 4, 8), strict=True)})
        query = np.zeros(40)
        query[ids] = w
        near, scores = index.nearest(ids, w, 15)
        assert np.allclose(np.sort(scores)[::-1], np.sort(vectors @ query)[::-1][: len(scores)], atol=1e-5)


def test_toxicity_finds_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    scored = op8_toxicity.op8_toxicity(spark, folder).where("held_out")
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("toxic is not null").select("toxic", "score").collect()
    bad, good = [r["score"] for r in rows if r["toxic"] == 1], [r["score"] for r in rows if r["toxic"] == 0]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.9
    assert np.mean(np.array(good) >= 0.7) < 0.05


def test_skipped_blocks_change_no_neighbour(monkeypatch):
    rng = np.random.default_rng(8)
    vocabulary = [(f"t{i}", float(w)) for i, w in enumerate(rng.pareto(1, 300) + 1)]
    examples = [(i % 2, {f"t{k}": 1 for k in rng.integers(0, 300, 20)}) for i in range(1500)]
    index = toxicity.build_index(vocabulary, examples)
    queries = [index.vector({int(k): 1 for k in rng.integers(0, 300, 40)}) for _ in range(30)]
    whole = [index.nearest(*q, 15) for q in queries]
    monkeypatch.setattr(toxicity, "GROUP", 4)
    for q, (near, scores) in zip(queries, whole, strict=True):
        found = index.nearest(*q, 15)
        assert near.tolist() == found[0].tolist() and np.allclose(scores, found[1])


def test_toxicity_learns_whole_words_from_few_rows(spark):
    """Six toxic rows of 46; bad and good words begin alike."""
    rng = np.random.default_rng(5)
    filler = [f"word{i}" for i in range(400)]
    text = lambda word: " ".join([*rng.choice(filler, 30), word, *rng.choice(filler, 5)])
    rows = [(i, text("stupidest" if i < 6 else "stupendous"), int(i < 6)) for i in range(46)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert set(model.index.terms) == {w for r in rows for w in r[1].split()}
    bad, good = ([model.score(text(w))[0] for _ in range(20)] for w in ("stupidest", "stupendous"))
    assert min(bad) > max(good)


def test_copies_take_one_place_among_the_examples(spark):
    """300 copies of one text of a label, and 40 places: all 40 are different texts, whatever the copies' hash is."""
    texts = [f"common{i % 3} good{i} fine{i}" for i in range(40)]
    for copied in texts[:3]:
        rows = [(i, t) for i, t in enumerate([*texts, *[copied] * 300])]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        model = toxicity.fit(docs, docs.selectExpr("doc_id", "0 as toxic"), max_examples=40)
        assert len(model.names) == 40 and sorted(model.index.rows) == [1] * 39 + [301]


def test_toxicity_query_equals_brute_force(spark, folder_of):
    """All cosines of all pairs by dicts, with copies, rows without a label and texts of unseen words."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)]
    text = lambda bad: " ".join([*rng.choice(words, rng.integers(3, 25)), *["vile"] * int(bad * rng.integers(1, 3))])
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(160)]
    rows += [(200 + i, rows[4][1], 1) for i in range(9)] + [(300, None, 0), (301, "", 0), (302, "unseen words only", 1), (303, "w1 w2 unheard", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 10 != 9], "doc_id long, toxic int")
    folder = folder_of(documents=docs, labels=labels)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    train = Counter((y, t or "") for i, t, y in rows if i % 10 != 9 and not held(i))
    train = sorted(train.items(), key=lambda x: (-x[0][0], hashlib.md5(x[0][1].encode()).hexdigest()))
    n, n1 = sum(c for _, c in train), sum(c for (y, _), c in train if y)
    d, d1 = Counter(), Counter()
    for (y, t), c in train:
        for w in set(t.split()):
            d[w] += c
            d1[w] += c * y

    def vector(t):
        v = {w: (1 + math.log(f)) * (1 + math.log((1 + n) / (1 + d[w]))) for w, f in Counter(t.split()).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    known = [(y, t, c, vector(t)) for (y, t), c in train]

    def raw(t, skip=None):
        v, own = vector(t), known[skip][2] if skip is not None else 0
        near = [(-sum(x * w.get(k, 0.0) for k, x in v.items()), j) for j, (_, _, _, w) in enumerate(known) if not (j == skip and own == 1)]
        near = sorted((round(s, 12), j) for s, j in near if s < 0)[: toxicity.NEIGHBOURS]
        if not near:
            return None
        weights = [-s * (known[j][2] - (j == skip)) for s, j in near]
        y = known[skip][0] if skip is not None else 0
        signs = 0.0
        for w in {*t.split()} & {*d}:
            a, b, m1, m = d1[w] - own * y, d[w] - own, n1 - own * y, n - own
            spread = b * (m - b) * m1 * (m - m1)
            z = (a * m - b * m1) * math.sqrt(m / spread) if spread > 0 else 0.0
            signs += math.copysign(max(0.0, abs(z) - toxicity.SURE), z)
        return sum(x * known[j][0] for x, (_, j) in zip(weights, near, strict=True)) / sum(weights), signs

    own = [raw(t, i) for i, (_, t, _, _) in enumerate(known)]
    x = np.array([o for o in own if o])
    y, c = (np.array([float(k[f]) for o, k in zip(own, known, strict=True) if o]) for f in (0, 2))
    c = c * np.where(y == 1, ((1 - y) @ c) / (y @ c), 1.0)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    b = toxicity.logistic((x - mean) / spread, y, c)
    edges, levels = toxicity.calibrate((x - mean) / spread @ b[:2] + b[2], y, c)
    blanks = [(k[0], k[2]) for o, k in zip(own, known, strict=True) if not o]
    blank = sum(k for z, k in blanks if z) / max(1, sum(k for _, k in blanks)) if blanks else n1 / n
    wanted = {}
    for i, t, _ in rows:
        found = raw(t or "")
        wanted[i] = blank if found is None else levels[np.searchsorted(edges, (np.array(found) - mean) / spread @ b[:2] + b[2] + 1e-9, side="right") - 1]
    result = {r["doc_id"]: r for r in op8_toxicity.op8_toxicity(spark, folder).collect()}
    assert set(result) == set(wanted)
    assert all(r["held_out"] == held(i) and r["predicted"] == int(r["score"] >= 0.7) for i, r in result.items())
    assert np.mean([abs(r["score"] - wanted[i]) < 1e-6 for i, r in result.items()]) > 0.97  # bins meet at equal values


def test_toxicity_of_odd_rows(spark, documents):
    labels = spark.createDataFrame([(3, 1), (8, 0), (999, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.fit(documents, labels)
    found = toxicity.scored(documents, model).select("doc_id", "toxicity.score").collect()
    assert len(found) == documents.count() and all(0 <= r["score"] <= 1 for r in found)
    empty = toxicity.fit(documents, labels.where("false"))
    assert {r["score"] for r in toxicity.scored(documents, empty).select("toxicity.score").collect()} == {0.0}
    assert toxicity.clean_documents(documents.where("false"), model).columns == documents.columns


def test_base_scores_equal_brute_force(spark, documents):
    from pyspark.sql import functions as F

    found = {(r["doc_id"], r["n_tokens"]): r for r in ppm.scores(documents, key="doc_id", text="text", train=F.col("doc_id") % 2 == 0).collect()}
    tokens = {(r["doc_id"], i): [*re.findall(r"[^ \t-\r]+", low(r["text"])), None] for i, r in enumerate(documents.collect())}
    train = Counter(t for (d, _), w in tokens.items() if d % 2 == 0 for t in w)
    n, v = sum(train.values()), len(train)
    for (d, _), w in tokens.items():
        r = found[d, len(w)]
        assert (r["n_known"], r["train_tokens"]) == (sum(train[t] > 0 for t in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w), rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] <= 0


def test_model_scores_equal_a_trie_of_plain_dicts(spark, documents):
    found = {(r["doc_id"], r["n_tokens"]): r["score"] for r in ppm.scores(documents, key="doc_id", text="text", train=F.col("doc_id") % 2 == 0).collect()}
    trie = defaultdict(Counter)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in documents.collect()]

    def steps(text):
        symbols = [ppm.START] * ppm.ORDER + [*text, ppm.END]
        for i in range(ppm.ORDER, len(symbols)):
            yield [tuple(symbols[i - n : i]) for n in range(ppm.ORDER, -1, -1)], symbols[i]

    for key, text in rows:
        if key % 2 == 0:
            for contexts, symbol in steps(text):
                for c in contexts:
                    trie[c][symbol] += 1
    for key, text in rows:
        total = 0.0
        for contexts, symbol in steps(text):
            excluded = set()
            for c in contexts:
                left = {x: n for x, n in trie.get(c, {}).items() if x not in excluded}
                size = sum(left.values()) + len(left)
                if symbol in left:
                    total += math.log10(left[symbol] / size)
                    break
                total += math.log10(len(left) / size) if left else 0.0
                excluded |= left.keys()
            else:
                total -= math.log10(257 - len(excluded))
        assert found[key, len(text.split()) + 1] == pytest.approx(total, rel=1e-5)


def test_scores_without_training_texts_and_of_an_empty_table(spark, documents):
    some = documents.where("doc_id in (1, 8)")
    found = {r["doc_id"]: r["score"] for r in ppm.scores(some, key="doc_id", text="text", train=F.lit(False)).collect()}
    assert found == {1: pytest.approx(-math.log10(257)), 8: pytest.approx(-math.log10(257) * (len("short text") + 1))}
    assert ppm.scores(documents.where("false"), key="doc_id", text="text", train=F.lit(True)).count() == 0


def test_adaptive_code_is_a_distribution():
    """After a context, the probabilities of all bytes and the end add up to at most one, and repeats get shorter."""
    text = b"abracadabra abracadabra"
    before = ppm.adaptive(text)
    total = sum(10 ** (ppm.adaptive(text + bytes([b])) - before) for b in range(256))
    assert total < 256 and ppm.adaptive(b"ab" * 200) > ppm.adaptive(bytes(np.random.default_rng(1).integers(0, 256, 400, dtype=np.uint8)))


def ids_of(text):
    tok = Tokenizer.from_file(tokenizer_file())
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def test_pieces_hold_every_id_once(spark, documents):
    found = packing.pack(documents.dropDuplicates(["doc_id"]), "doc_id", "text", tokenizer_file(), with_ids=False).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text in texts.items():
        ids, at = ids_of(text), 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_no_window_of_packing_carries_maps(spark, documents):
    """The window over all blocks goes through one task."""
    plan = packing.pack(documents, "doc_id", "text", tokenizer_file(), with_ids=False)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    windows = [i for i, line in enumerate(plan) if "Window [" in line]
    assert len(windows) == 2
    for i in windows:
        for line in plan[i + 1 :]:
            if len(line) - len(line.lstrip(" :+-")) <= plan[i].index("Window ["):
                break
            assert "map_from_entries" not in line


@pytest.mark.parametrize("seed", range(4))
def test_packing_leaves_little_padding(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(np.minimum(rng.lognormal(5, 1, 3000).astype(int) + 1, 1023).tolist())
    plan = packing.make_plan(dict(counts))
    bound = math.ceil(sum(k * n for k, n in counts.items()) / 1024)
    used = {s for size, n in counts.items() for rank in range(n) for s, *_ in packing.place(plan, size, rank)}
    assert len(used) <= bound * 1.02 + 2


def test_token_files_round_trip(spark, documents):
    folder = token_store.write_store(documents, "doc_id", "text", tokenizer_file())
    at = 0
    found = token_store.read_store(spark, folder, digest=True).orderBy("start").collect()
    texts = sorted(((r["doc_id"], r["text"]) for r in documents.collect()), key=lambda x: x[0])
    for r, (doc, text) in zip(found, texts, strict=True):
        ids = ids_of(text)
        assert (r["key"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("at_once", [100_000, 2])
def test_lookup_finds_keys_that_are_there_and_no_others(spark, documents, monkeypatch, at_once):
    monkeypatch.setattr(token_store, "SHARDS_AT_ONCE", at_once)
    rows = documents.union(documents.where("doc_id = 1").withColumn("doc_id", documents["doc_id"] + 1000)).withColumn("doc_id", F.when(F.col("doc_id") == 2, None).otherwise(F.col("doc_id") * 10))
    folder = token_store.write_store(rows.repartition(5), "doc_id", "text", FILE)
    asked = spark.createDataFrame([(k, "x", 1) for k in (*range(-5, 145), 10_009, 10_010, 10_011, 1 << 60, 30, 30, None)], "k long, name string, low int")
    found = sorted((r["key"], list(r["ids"])) for r in token_store.lookup(asked, "k", folder).collect())
    wanted = sorted((r["doc_id"], [*Tokenizer.from_file(FILE).encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in rows.where("doc_id is not null").collect())
    assert found == wanted


def test_lookup_by_texts_and_in_an_empty_store(spark, documents):
    rows = documents.select(F.concat(F.lit("ü"), "doc_id").alias("name"), "text").where("doc_id <> 3")
    folder = token_store.write_store(rows.repartition(3), "name", "text", FILE)
    asked = spark.createDataFrame([("ü1",), ("ü10",), ("u1",), ("ü99",), ("",)], "name string")
    assert sorted(r["key"] for r in token_store.lookup(asked, "name", folder).collect()) == ["ü1", "ü10"]
    empty = token_store.write_store(rows.where("false"), "name", "text", FILE)
    assert token_store.lookup(asked, "name", empty).count() == 0


def test_fingerprints_refuse_other_keys(spark, documents):
    folder = token_store.write_store(documents.coalesce(1), "doc_id", "text", FILE)
    shard = token_store.Shard(folder, token_store.manifest(spark, folder).first()["name"])
    assert all(len(w) == 0 for w in shard.find(pa.array([*range(100, 5000), None, -1])))
    assert [len(w) for w in shard.find(pa.array([0, 3, 14]))] == [1, 2, 1]


def test_spans_are_places_in_the_original(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    text = "Über  Ähren — ALPHA,beta; gamma\ndelta (epsilon) zeta\teta theta iota kappa λ lambda"
    long = "ö! " + item.upper().replace(" ", " .. ") + " ÿ"
    docs = spark.createDataFrame([(1, text), (2, long), (3, "x Short-Item ü short item"), (4, None), (5, "short items")], "doc_id long, text string").withColumn("hits", F.lit("clash"))
    items = spark.createDataFrame([("a", item), ("b", "short item"), ("c", None), ("d", "--")], "item_id string, text string")
    found = {r["doc_id"]: r["hits"] for r in decontaminate.hits(docs, items, spans=True).collect()}
    words = [m.group(0) for m in re.finditer("[A-Z]+", long)]
    begin, end = long.index("ALPHA"), long.index("NU") + 2
    assert [(s["start"], s["end"], s["item_id"]) for s in found[2]["spans"]] == [(begin, end, "a"), (long.index("BETA"), long.index("XI") + 2, "a")]
    assert (found[2]["n_hit"], found[2]["n_words"]) == (len(words), len(words) + 2)
    three = "x Short-Item ü short item"
    assert [three[s["start"] : s["end"]] for s in found[3]["spans"]] == ["Short-Item", "short item"]
    assert not found[1]["spans"] and not found[4]["spans"] and not found[5]["spans"]
    none = decontaminate.hits(docs, items.where("false"), spans=True).collect()
    assert all(r["hits"]["n_hit"] == 0 and not r["hits"]["spans"] for r in none)


def test_minimal_perfect_hash():
    hashes = np.unique(np.random.default_rng(2).integers(0, 2**63, 5000, dtype=np.uint64))
    mph, _ = token_store.build_mph(hashes)
    slots = token_store.find_slots(mph, hashes)
    assert sorted(slots.tolist()) == list(range(len(hashes)))


def test_empty_tables(spark, documents):
    none = documents.where("false")
    assert packing.pack(none, "doc_id", "text", tokenizer_file(), with_ids=False).count() == 0
    assert token_store.read_store(spark, token_store.write_store(none, "doc_id", "text", tokenizer_file())).count() == 0
    assert decontaminate.clean_documents(none, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
