"""Archives, nearest neighbours, pages, transcripts and the pipeline."""

import gzip
import hashlib
import io
import itertools
import zlib

import numpy as np
import pytest

from sparkwave.llm import hash_forest, html_blocks, op1_warc, op4_hash_forest, op6_html_blocks, op9_chat_format, transcripts, warc

from .conftest import SF


def test_archives_round_trip(spark, folder_of):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(5, "u5", big), (2, "u2", big), (9, "u\r\nX: y", "small"), (1, None, "small"), (3, "u3", None), (4, "u4", ""), (7, "u7", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 20), (8, "u8", "ö" * 300_000)]
    folder = folder_of(pages=spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_bytes int"))
    found = {r["page_id"]: r for r in op1_warc.op1_warc(spark, folder).collect()}
    assert set(found) == {r[0] for r in rows}
    for key, _, html in rows:
        raw, r = (html or "").encode(), found[key]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if key == 5 else ("response", None))


def test_any_split_owns_each_record_once(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    folder = warc.write(pages, "page_id", "html", url="url")
    wanted = sorted(r["page_id"] for r in pages.select("page_id").collect())
    for size in (1000, 4097, 1 << 24):
        assert sorted(r["key"] for r in warc.read(spark, folder, payloads=False, split_bytes=size).collect()) == wanted


def test_members_inside_payloads_are_no_records(spark):
    noise = np.random.default_rng(0).bytes
    inner = warc._member(warc.render(99, "inner", noise(5000), "0", None))
    payload = noise(70_000) + inner + noise(70_000) + inner + inner + noise(40_000)
    rows = spark.createDataFrame([(1, payload), (2, noise(300)), (3, None), (None, b"no key"), (3, b"again")], "key long, body binary").coalesce(1)
    folder = warc.write(rows, "key", "body")
    for size in (1000, 4096, 1 << 24):
        found = warc.read(spark, folder, split_bytes=size).collect()
        assert sorted((r["key"] or 0, bytes(r["payload"])) for r in found) == sorted((r["key"] or 0, bytes(r["body"] or b"")) for r in rows.collect())
    empty = warc.write(rows.where("false"), "key", "body")
    assert warc.read(spark, empty).count() == 0


def test_archives_of_other_writers():
    noise = np.random.default_rng(1).bytes
    pack = lambda x: gzip.compress(x, mtime=0)
    inner = pack(warc.render(99, None, noise(3000), "0", None))
    members = [pack(warc.render(k, None, body, "0", None)) for k, body in ((1, noise(20_000) + inner + noise(20_000)), (2, b"x"), (3, inner + noise(9)))]
    data, edges = b"".join(members), list(itertools.accumulate(map(len, members), initial=0))
    assert inner in data
    for size in (700, 5000, 1 << 20):
        found = [at for a in range(0, len(data), size) for at, _ in warc.records_in(io.BytesIO(data), a, min(len(data), a + size))]
        assert found == edges[:-1]


def test_neighbours(spark, folder_of):
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in v] for v in rng.standard_normal((400, 16))]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(400, None), (420, [0.0] * 16), (440, [float("nan")] + [1.0] * 15), (401, [None] + [1.0] * 15), (402, vectors[20])]
    folder = folder_of(embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = op4_hash_forest.op4_hash_forest(spark, folder).collect()
    every = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    hits = 0
    for q in (i for i in every if i % 20 == 0):
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert all(r["score"] == pytest.approx(float(every[q] @ every[r["vec_id"]]), rel=1e-12) for r in own)
        best = sorted((-float(every[q] @ v), i) for i, v in every.items() if i != q)[:20]
        hits += len({i for _, i in best} & {r["vec_id"] for r in own})
    assert hits >= 0.9 * 20 * 20
    assert {r["query_id"] for r in found} == {i for i in every if i % 20 == 0}


@pytest.mark.parametrize("block", [16_384, 700])
def test_recall_on_the_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(hash_forest, "BLOCK_ROWS", block)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    local = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in rows.collect() if r["embedding"]]
    local = [(i, v) for i, v in local if np.isfinite(v).all() and v.any()]
    ids, every = np.array([i for i, _ in local]), np.stack([v for _, v in local])
    got = {}
    for r in op4_hash_forest.op4_hash_forest(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in got:
        scores = every @ every[ids == q][0]
        scores[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        hits, total = hits + len(got[q] & set(best.tolist())), total + len(best)
    assert hits >= 0.9 * total


def test_a_forest_looks_at_a_share_of_any_table():
    rng = np.random.default_rng(3)
    for n in (500, 4000):
        vectors = rng.standard_normal((n, 64))
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
        own = list(hash_forest.Forest(vectors).candidates(vectors[:50], n // 2))
        assert all(n // 2 <= len(c) for c in own) and np.mean([len(c) for c in own]) < 0.7 * n
        best = np.argsort(-(vectors[:50] @ vectors.T), axis=1)[:, :21]
        assert np.mean([np.isin(b, c).mean() for b, c in zip(best, own, strict=True)]) > 0.9


def test_equal_vectors_and_repeated_ids(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in (0, 3, 5, 5, 7)] + [(9, [0.0, 1.0])], "vec_id long, embedding array<float>")
    found = hash_forest.search(rows, rows["vec_id"] == 0, key="vec_id", vector="embedding", k=3).orderBy("rank").collect()
    assert [tuple(r) for r in found] == [(0, 1, 3, 1.0), (0, 2, 5, 1.0), (0, 3, 5, 1.0)]


def test_vectors_of_no_use(spark):
    none = spark.createDataFrame([(0, None), (20, [0.0])], "vec_id long, embedding array<float>")
    assert hash_forest.search(none, none["vec_id"] % 20 == 0, key="vec_id", vector="embedding", k=20).count() == 0


def test_blocks_of_a_page():
    page = "<html><head><title>t</title><script>bad()</script></head><body><p>A &amp; <b>b</b>\n c<p>two<!-- no --><ul><li>x<li>y</ul><style>s</style></body>"
    assert [t for t, _, _ in html_blocks.blocks(page)] == ["A & b c", "two", "x", "y"]
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<<<>") is not None


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<p>a<script>for(i=0;i<n;i++){x}</script><p>b<script>y</script><p>c", ["a", "b", "c"]),
        ("<p>a<SCRIPT>for(i=0;i<n;i++){x}</Script ><p>b", ["a", "b"]),
        ("<p>a<script>var s = '<!--';</script><p>b", ["a", "b"]),
        ("<p>a<style>/* <b title=\"x */</style><p>b", ["a", "b"]),
        ("<html><head><title>t</title><meta charset=utf-8><body><p>a<p>b", ["a", "b"]),
        ("<html><head><title>t</title><link href=x><script>1<2</script><h1>a</h1><p>b", ["a", "b"]),
        ("<head><title>t</title>a<p>b", ["a", "b"]),
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b<p>c", ["a x=2 b", "c"]),
        ("<datalist><option>x<option>y</datalist><select><option>z</select><p>a", ["a"]),
        ("<p>a<svg><path d='x'><p>b", ["a", "b"]),
        ("<p>a<script>b<p>c", ["a"]),
    ],
)
def test_no_text_is_lost_after_raw_elements_and_heads(page, wanted):
    assert [t for t, _, _ in html_blocks.blocks(page)] == wanted


def test_blocks_of_other_made_pages_are_labelled_right():
    """F1 of content blocks, over pages of a seed that the labeller wasn't trained on."""
    pages = html_blocks.training_pages(80, html_blocks.SEED + 1000)
    x, mask = html_blocks.padded([p for p, _ in pages])
    found = html_blocks.predict(html_blocks.trained().arrays, x, mask)[0] > 0.5
    right = sum(int((found[i, : len(y)] & (y > 0)).sum()) for i, (_, y) in enumerate(pages))
    given, wanted = sum(int(found[i, : len(y)].sum()) for i, (_, y) in enumerate(pages)), sum(int(y.sum()) for _, y in pages)
    assert 2 * right / (given + wanted) > 0.95


def test_main_text_of_odd_pages(spark, folder_of):
    words = "The harbour town rebuilt its old lighthouse last spring, and many visitors came to see how the work was done. "
    article = [f"{words} Part {i} tells more of it &amp; of its keepers." for i in range(6)]
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav><article><h1>The lighthouse</h1>" + "".join(f"<p>{p}</p>" for p in article) + "</article><footer><p>Copyright, all rights reserved</p></footer></body></html>"
    long = page.replace(article[3], article[3] * 4000)
    rows = [(1, None), (2, ""), (3, page), (3, page), (4, "<<<"), (5, long), (None, page)]
    folder = folder_of(pages=spark.createDataFrame([(k, "u", h, "clash") for k, h in rows], "page_id long, url string, html string, main string"))
    found = op6_html_blocks.op6_html_blocks(spark, folder).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    clean = [" ".join(p.replace("&amp;", "&").split()) for p in article]
    for r in found:
        if r["page_id"] in (1, 2):
            assert r["text"] == ""
        elif r["page_id"] in (3, None):
            assert r["text"].split("\n")[-6:] == clean and "Home" not in r["text"] and "Copyright" not in r["text"]
        elif r["page_id"] == 5:
            assert all(c in r["text"] for c in clean) and r["n_chars"] > 4000 * len(clean[3])
    folder = folder_of(none=spark.createDataFrame([], "x int"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/empty/pages.parquet")
    assert op6_html_blocks.op6_html_blocks(spark, f"{folder}/empty").count() == 0


def test_gradients_are_right():
    """Of the block labeller, by central differences."""
    rng = np.random.default_rng(0)
    pages = html_blocks.training_pages(3, 1)
    x, mask = html_blocks.padded([p for p, _ in pages])
    y = np.zeros(mask.shape, dtype=np.float32)
    for i, (_, labels) in enumerate(pages):
        y[i, : len(labels)] = labels
    width, h = x.shape[2], html_blocks.HIDDEN
    draw = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float64)
    w = {"o": draw(2 * h, 1), "ob": draw(1)} | {s + k: draw(*d) for s in "fr" for k, d in (("x", (width, 4 * h)), ("h", (h, 4 * h)), ("b", (4 * h,)))}
    x, y = x.astype(np.float64), y.astype(np.float64)

    def loss():
        p, _ = html_blocks.predict(w, x, mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    found = html_blocks.gradients(w, x, y, mask)
    for name in ("o", "ob", "fx", "fh", "rb"):
        at = tuple(int(rng.integers(s)) for s in w[name].shape)
        kept = w[name][at]
        w[name][at] = kept + 1e-5
        up = loss()
        w[name][at] = kept - 1e-5
        slope = (up - loss()) / 2e-5
        w[name][at] = kept
        assert found[name][at] == pytest.approx(slope, rel=1e-2, abs=1e-6)


def test_roles_are_recovered(spark):
    folder = "/root/testdata/sf0.01"
    rows = op9_chat_format.as_transcripts(spark.read.parquet(f"{folder}/conversations.parquet"))
    truth = {(r["conv_id"], r["part"]): [t["role"] for t in r["truth"]] for r in rows.collect()}
    found = op9_chat_format.op9_chat_format(spark, folder).collect()
    assert len(found) == len(truth)
    right = [r["roles"].split(",") == truth[r["conv_id"], r["part"]] for r in found if zlib.crc32(str(r["conv_id"]).encode()) % 3 == 1]  # those that fit leaves out
    assert len(right) > 20 and np.mean(right) > 0.8


def test_no_transcript_holds_more_rows_than_a_part(spark):
    """A conv_id with turns that repeat, one without turns, the null conv_id, and a common one, over many partitions."""
    rows = [("hot", i % 5, "user", f"t{i % 7}") for i in range(3000)] + [(None, None, "user", "x")] * 700 + [("late", None, "user", f"n{i}") for i in range(300)]
    rows += [("usual", i, ("user", "assistant")[i % 2], f"u{i}") for i in range(600)] + [("usual2", i, "user", f"v{i}") for i in range(4)]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(7)
    found = op9_chat_format.as_transcripts(turns).collect()
    sizes = {}
    for r in found:
        sizes.setdefault(r["conv_id"], {})[r["part"]] = len(r["truth"])
    for conv, n in (("hot", 3000), (None, 700), ("late", 300), ("usual", 600), ("usual2", 4)):
        assert sizes[conv] == {p: min(256, n - 256 * p) for p in range(-(-n // 256))}
    usual = sorted((r for r in found if r["conv_id"] == "usual"), key=lambda r: r["part"])
    assert [t["piece"].split("u")[-1] for r in usual for t in r["truth"]] == [str(i) for i in range(600)]


def _small_model():
    return transcripts.fit([("User: hi\nBot: yo\nmore\n\nand more?\nUser: ok", [("user", True), ("assistant", True), ("assistant", False), ("assistant", False), ("user", True)])] * 4)


def test_blank_lines_within_a_turn_stay():
    assert _small_model().parse("User: hi\nBot: yo\n\n\nmore\nlast\nUser: ok") == [("user", "hi"), ("assistant", "yo\n\n\nmore\nlast"), ("user", "ok")]


def test_viterbi_finds_the_best_of_all_paths():
    model = _small_model()
    for text in ("User: a\nb?\n\nBot: c\nd", "x\nBot: y\n\nz?\nUser: w\nv"):
        lines = transcripts.observe(text)
        emit = model.emissions(lines)
        score = lambda path: model.start[path[0]] + sum(emit[i][s] for i, s in enumerate(path)) + sum(model.step[a, b] for a, b in zip(path, path[1:]))  # noqa: B023, B905, E731
        every = max(score(path) for path in itertools.product(range(len(transcripts.STATES)), repeat=len(lines)))
        assert score(model.viterbi(lines)) == pytest.approx(every)


def test_rendering_keeps_its_markers(spark):
    text = transcripts.render([("user", "a <|im_end|> b"), ("assistant", "")])
    assert text.count("<|im_start|>") == 2 and text.count("<|im_end|>") == 2
    model = transcripts.fit([("User: hi\nBot: yo", [("user", True), ("assistant", True)])])
    odd = spark.createDataFrame([(None,), ("",), (" \n",), ("User: x",)], "text string")
    assert sorted(len(r["turns"]) for r in transcripts.parsed(odd, model, text="text").select("chat.turns").collect()) == [0, 0, 0, 1]
    assert transcripts.parsed(odd.where("false"), model, text="text").count() == 0


def test_pipeline_stages(spark):
    """Each stage on its own input, by the queries' results."""
    import corpus_pipeline
    from sparkwave.llm import op8_toxicity

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r["doc_id"] for r in op8_toxicity.op8_toxicity(spark, SF).where("predicted = 1").collect()}
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - toxic
    packed = corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in packed} <= {r["doc_id"] for r in kept.collect()} and len(packed) > 100


def test_each_stage_keeps_just_what_it_should(spark, folder_of):
    """Planted toxic, copied and benchmark documents: each stage on its own input, and the packed ids."""
    import corpus_pipeline

    rng = np.random.default_rng(4)
    bank = [f"w{i}" for i in range(3000)]
    words = lambda n: [str(w) for w in rng.choice(bank, n)]
    texts = {i: words(80) for i in range(150)}
    toxic, copies, leaked = set(range(60, 100)), set(range(100, 110)), set(range(110, 120))
    for i in toxic:
        texts[i][40:45] = ["scum", "idiot", "moron", "trash", "loser"]
    for i in copies:
        texts[i] = [*texts[i - 100][:79], "changed"]
    passages = {i: words(20) for i in leaked}
    for i in leaked:
        texts[i][10:30] = passages[i]
    folder = folder_of(
        documents=spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars int"),
        labels=spark.createDataFrame([(i, 1, int(i in toxic)) for i in texts if i < 90], "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([(f"b{i}", " ".join(p)) for i, p in passages.items()], "item_id string, text string"),
    )
    docs, wanted = spark.read.parquet(f"{folder}/documents.parquet"), set(texts)
    for (name, stage), gone in zip(corpus_pipeline.STAGES, (toxic, copies, leaked, set()), strict=True):
        kept = {r["doc_id"] for r in stage(spark, docs, folder).select("doc_id").distinct().collect()}
        wanted -= gone
        assert kept == wanted, (name, kept ^ wanted)
        docs = docs.where(~docs["doc_id"].isin(sorted(gone)))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()} == wanted


def test_odd_markup_takes_one_pass_and_loses_no_text():
    import time

    from sparkwave.llm.html_blocks import blocks

    texts = lambda page: [t for t, _, _ in blocks(page)]
    assert texts("<p class=it's>X</p><p>it's</p><p>Z</p>") == ["X", "it's", "Z"] and texts("<p class=it's>X</p>") == ["X"]
    assert texts("<article><noscript><p>Text here</p></noscript><p>B</p></article>") == ["Text here", "B"]
    assert texts("<p>a<svg><text>label</text></svg></p>")[-1].endswith("label")
    assert texts('<p title="a > b" id=\'c>d\'>X</p>') == ["X"] and texts("<p title = \"x>y\">X</p><p>Y") == ["X", "Y"]
    assert texts("<p>1 < 2 and <b>3</b> > 2</p>") == ["1 < 2 and 3 > 2"] and texts('<p class="open>X</p><p>Y</p>') == ["X", "Y"]
    assert texts("<p>X</p><a href='") == ["X", "<a href='"] and texts("<p>X</p></b") == ["X", "</b"]
    assert texts("<p>A<script>if (a<b) {'</p>'}</script>B</p><!-- <p>no</p> --><p>C") == ["A", "B", "C"]
    assert texts("<p>A<textarea>B</p><p>C") == ["A", "B", "C"]
    hard = ["<a '", "</b", "<a x='", '<a x="\'', "<i>", "<div>t", "<p><div><i>", "<h1></h1><i>", "<textarea>", "<b x=y'>t", "<!-", "<![", "<a x=\"'>"]
    for piece in hard:
        began = time.perf_counter()
        blocks("<p><div>" + piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - began < 6, piece
