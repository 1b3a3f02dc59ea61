"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ``ORDER`` bytes with symbol counts, learnt from all training texts. A symbol
is a byte or the end of a text; a text begins in a context of start marks. In a context with total T and D distinct
symbols, a symbol counted c times has probability c / (T + D) and the escape to the next shorter context D / (T + D).
Symbols of the longer context are excluded from T and D of the shorter one; below the empty context the symbols not
seen at all are equally likely. A text's score is the sum of the logarithms, to base 10, with its end. ``adaptive``
scores each text by a trie that it alone fills, symbol by symbol.

The trie's levels are sorted arrays: a context followed by a symbol is a number of ``BITS`` bits a symbol, so a node's
children are a slice, and a suffix is the low bits. Only the deepest level is counted in the corpus; shorter contexts are
sums of it. Tasks count in numpy, counts meet by a hash of the gram, and the merged table is written to shared scratch,
from where each worker builds the trie once. Its size follows the number of distinct grams of ORDER + 1 bytes.

``unigrams`` gives the base score: words and one end per text, with add-0.1 smoothing. Distinct words of each text meet by
hash in buckets, which count them and return each text's sum of logarithms; no vocabulary is broadcast.

Defined cases: null and empty texts have only their end; null keys and repeated rows are scored as any row; without
training texts every symbol is equally likely; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, scratch_dir, ship_package
from .common import open_fs, slices, text_slices
from .shingles import word_hashes

ORDER = 5
BITS = 9
END, START, SYMBOLS = 256, 257, 257
BATCH_BYTES = 2_000_000
GRAM_BUCKETS = 32
WORDS_IN_BUCKET = 2_000_000
SMOOTHING = 0.1


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each text, with its end: context and symbol as one number; and the text's number."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    pad = b"\0" * order
    raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\0")), dtype="u1").astype(np.uint64)
    begins = np.cumsum(sizes + order + 1) - (sizes + order + 1)
    for i in range(order):
        raw[begins + i] = START
    raw[begins + order + sizes] = END
    out = raw[order:].copy()
    for i in range(1, order + 1):
        out |= raw[order - i : len(raw) - i] << np.uint64(BITS * i)
    return out[raw[order:] != START], np.repeat(np.arange(len(texts)), sizes + 1)


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[edge], np.add.reduceat(counts, edge, dtype=np.int64) if len(edge) else counts


class Trie:
    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order = order
        self.keys, self.counts, self.contexts, self.totals, self.kinds = [], [], [], [], []
        for level in range(order + 1):  # level j: contexts of j symbols
            low = keys & np.uint64((1 << BITS * (level + 1)) - 1)
            k, c = (keys, counts) if level == order else _sum_by(low, counts)
            edge = np.flatnonzero(np.concatenate([[True], (k[1:] ^ k[:-1]) >> np.uint64(BITS) != 0])) if len(k) else np.zeros(0, dtype=np.int64)
            self.keys.append(k)
            self.counts.append(c)
            self.contexts.append(k[edge] >> np.uint64(BITS))
            self.totals.append(np.add.reduceat(c, edge, dtype=np.int64) if len(edge) else np.zeros(0, dtype=np.int64))
            self.kinds.append(np.diff(np.append(edge, len(k))).astype(np.int32))
        # of each context of level j + 1: what its symbols leave in the context of level j
        self.left_totals, self.left_kinds = [], []
        for level in range(order):
            longer, width = self.keys[level + 1], np.uint64((1 << BITS * (level + 1)) - 1)
            inside = self.counts[level][np.searchsorted(self.keys[level], longer & width)]
            edge = np.cumsum(self.kinds[level + 1]) - self.kinds[level + 1]
            covered = np.add.reduceat(inside, edge) if len(edge) else np.zeros(0, dtype=np.int64)
            shorter = np.searchsorted(self.contexts[level], self.contexts[level + 1] & (width >> np.uint64(BITS)))
            self.left_totals.append(self.totals[level][shorter] - covered)
            self.left_kinds.append(self.kinds[level][shorter] - self.kinds[level + 1])
        self.deepest = np.log10(counts / np.repeat(self.totals[order] + self.kinds[order], self.kinds[order])).astype(np.float32) if len(counts) else np.zeros(0, dtype=np.float32)
        self.counts[order] = None  # the deepest level is large, and its logarithms are all that is asked for

    def log10(self, grams_: np.ndarray) -> np.ndarray:
        """Log-probability of each gram's symbol after its context; fast for sorted grams."""
        out = np.zeros(len(grams_))
        open_, longer = np.arange(len(grams_)), np.full(len(grams_), -1, dtype=np.int64)
        for level in range(self.order, -1, -1):
            keys, contexts = self.keys[level], self.contexts[level]
            if not len(keys) or not len(open_):
                continue
            own = grams_[open_] & np.uint64((1 << BITS * (level + 1)) - 1)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[at] == own
            if level == self.order:
                out[open_[hit]] = self.deepest[at[hit]]
                open_, own, longer, at = open_[~hit], own[~hit], longer[~hit], at[~hit]
                hit = np.zeros(len(open_), dtype=bool)
            context = np.minimum(np.searchsorted(contexts, own >> np.uint64(BITS)), len(contexts) - 1)
            known = contexts[context] == own >> np.uint64(BITS)
            total, kinds = self.totals[level][context].astype(float), self.kinds[level][context].astype(float)
            if level < self.order:
                below = longer >= 0
                total[below], kinds[below] = self.left_totals[level][longer[below]], self.left_kinds[level][longer[below]]
            both = np.maximum(total + kinds, 1.0)
            with np.errstate(divide="ignore"):
                step = np.where(hit, 0.0 if level == self.order else np.log10(self.counts[level][at] / both), np.where(known & (kinds > 0), np.log10(kinds / both), 0.0))
            out[open_] += step
            open_, longer = open_[~hit], np.where(known, context, -1)[~hit]
        unseen = SYMBOLS - (len(self.keys[0]) if self.keys else 0)
        out[open_] -= math.log10(max(unseen, 1))
        return out


def adaptive(text: bytes, order: int = ORDER) -> float:
    """Log10 probability of one text by a trie that only the text's own symbols before each one fill."""
    trie: dict[tuple, dict[int, int]] = {}
    history, total = [START] * order, 0.0
    for symbol in [*text, END]:
        excluded: set[int] = set()
        for n in range(order, -1, -1):
            seen = trie.get(tuple(history[len(history) - n :]), {})
            left = {s: c for s, c in seen.items() if s not in excluded}
            if not left:
                continue
            size = sum(left.values()) + len(left)
            if symbol in left:
                total += math.log10(left[symbol] / size)
                break
            total += math.log10(len(left) / size)
            excluded |= left.keys()
        else:
            total -= math.log10(SYMBOLS - len(excluded))
        for n in range(order + 1):
            counts = trie.setdefault(tuple(history[len(history) - n :]), {})
            counts[symbol] = counts.get(symbol, 0) + 1
        history = [*history[1:], symbol] if order else history
    return total


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields])


GRAMS = _schema(("bucket", T.IntegerType()), ("grams", T.BinaryType()), ("counts", T.BinaryType()))


def _encoded(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def fit(texts: DataFrame, text: str = "text", *, order: int = ORDER) -> str:
    """Count the grams of all ``texts``; the model's folder in shared scratch."""
    ship_package(texts.sparkSession)
    folder = scratch_dir(texts.sparkSession, "ppm")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        _tries.clear()  # of an earlier model
        for batch in batches:
            for _, _, own in text_slices(batch.column(0), BATCH_BYTES):
                held.append(np.unique(grams(_encoded(own), order)[0], return_counts=True))
                if len(held) > 8:
                    held = [_sum_by(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
        if held:
            keys, counts = _sum_by(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            bucket = _bucket(keys)
            for b in range(GRAM_BUCKETS):
                part = bucket == b
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([keys[part].tobytes()], pa.binary()), pa.array([counts[part].astype("<i8").tobytes()], pa.binary())], schema=_arrow(GRAMS))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for b, k, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys, counts = np.frombuffer(k, dtype="<u8"), np.frombuffer(c, dtype="<i8")
                if b in held:
                    keys, counts = _sum_by(np.concatenate([held[b][0], keys]), np.concatenate([held[b][1], counts]))
                held[b] = keys, counts
        for b, (keys, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], schema=_arrow(GRAMS))

    counted = texts.select(F.col(text).alias("text")).mapInArrow(count, GRAMS)
    counted.repartition(GRAM_BUCKETS, "bucket").mapInArrow(merge, GRAMS).write.parquet(folder)
    return folder


def _bucket(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(GRAM_BUCKETS)


_tries: dict[str, Trie] = {}


def load(folder: str, order: int) -> Trie:
    """The trie of a model; each worker process builds it once."""
    if folder not in _tries:
        _tries.clear()
        fs, path = open_fs(folder)
        files = [f.path for f in fs.get_file_info(_selector(path)) if f.path.endswith(".parquet")]
        parts = [pq.read_table(f, filesystem=fs, columns=["grams", "counts"]) for f in files]
        column = lambda name, kind: np.frombuffer(b"".join(x for p in parts for x in p.column(name).to_pylist()), kind)
        keys, counts = column("grams", "<u8"), column("counts", "<i8").astype(np.uint32)
        del parts
        sort = np.argsort(keys)
        keys, counts = keys[sort], counts[sort]
        _tries[folder] = Trie(keys, counts, order)
    return _tries[folder]


def _selector(path: str):
    from pyarrow.fs import FileSelector

    return FileSelector(path)


SCORES = _schema(("row", T.LongType()), ("words", T.LongType()), ("score", T.DoubleType()))


def score(texts: DataFrame, folder: str, *, row: str, text: str = "text", order: int = ORDER) -> DataFrame:
    """(row, words, score) of each text: its word count and log10 probability. No shuffle."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for a, b, texts_ in text_slices(batch.column(1), BATCH_BYTES):
                own = _encoded(texts_)
                keys, of = grams(own, order)
                sort = np.argsort(keys)
                keys, of = keys[sort], of[sort]
                edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                logs = np.repeat(load(folder, order).log10(keys[edge]), np.diff(np.append(edge, len(keys))))
                sums = np.bincount(of, weights=logs, minlength=b - a)
                yield pa.RecordBatch.from_arrays([pa.array(rows[a:b], pa.int64()), pa.array([len(t.split()) for t in own], pa.int64()), pa.array(sums)], schema=_arrow(SCORES))

    return texts.select(row, text).mapInArrow(run, SCORES)


WORDS = _schema(("bucket", T.IntegerType()), ("batch", T.LongType()), ("blob", T.BinaryType()))
REPLIES = _schema(("batch", T.LongType()), ("rows", T.BinaryType()), ("sums", T.BinaryType()), ("known", T.BinaryType()), ("kinds", T.LongType()), ("total", T.LongType()))
SUMS = _schema(("row", T.LongType()), ("log_sum", T.DoubleType()), ("n_known", T.LongType()))


def _word_blob(hashes: np.ndarray, of: np.ndarray, times: np.ndarray, rows: np.ndarray, train: np.ndarray) -> bytes:
    texts, runs = np.unique(of, return_counts=True)
    seven = hashes.view("u1").reshape(-1, 8)[:, :7]
    return b"".join([np.array([len(texts)], "<i8").tobytes(), rows[texts].astype("<i8").tobytes(), runs.astype("<i4").tobytes(), train[texts].astype("u1").tobytes(), times.astype("<i4").tobytes(), seven.tobytes()])


def _read_words(blob: bytes) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    rows, runs, train = np.frombuffer(blob, "<i8", n, 8), np.frombuffer(blob, "<i4", n, 8 + 8 * n), np.frombuffer(blob, "u1", n, 8 + 12 * n)
    m, at = int(runs.sum()), 8 + 13 * n
    times = np.frombuffer(blob, "<i4", m, at)
    hashes = np.zeros((m, 8), dtype="u1")
    hashes[:, :7] = np.frombuffer(blob, "u1", 7 * m, at + 4 * m).reshape(-1, 7)
    return rows, runs, train, times, hashes.view("<u8").ravel()


def unigrams(texts: DataFrame, *, row: str, text: str = "text", train: str = "train") -> tuple[DataFrame, int, int]:
    """(row, log_sum, n_known) by row, and the distinct words and words of all training texts.

    log_sum adds log10(count + 0.1) over a text's words and n_known counts those with a count. Rows with the same ``row``
    are added up.
    """
    ship_package(texts.sparkSession)
    rows = texts.select(row, text, train)
    size = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = max(12, -(-int(size) // (8 * WORDS_IN_BUCKET)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        _tries.clear()
        batch_id = TaskContext.get().partitionId() << 24
        for batch in batches:
            names, learns = np.array(batch.column(0).to_pylist(), dtype=np.int64), np.array(batch.column(2).to_pylist(), dtype=bool)
            for a, b, texts_ in text_slices(batch.column(1), 4 * BATCH_BYTES):
                own, found = [t.lower() for t in _encoded(texts_)], []
                for lo, hi in slices(map(len, own), BATCH_BYTES // 2):
                    part = own[lo:hi]
                    starts, hashes = word_hashes(b"\n".join(part))
                    edges = np.cumsum([0, *(len(t) + 1 for t in part)])
                    found.append((hashes, np.searchsorted(edges, starts, side="right") - 1 + lo))
                hashes, of = np.concatenate([h for h, _ in found]), np.concatenate([o for _, o in found])
                if not len(hashes):
                    continue
                sort = np.lexsort((hashes, of))
                hashes, of = hashes[sort], of[sort]
                edge = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])]))
                times = np.diff(np.append(edge, len(hashes)))
                hashes, of = hashes[edge], of[edge]
                bucket = ((hashes >> np.uint64(56)) * np.uint64(0x9E3779B1) + (hashes >> np.uint64(40))) % np.uint64(buckets)
                sort = np.argsort(bucket.astype(np.int32), kind="stable")
                hashes, of, times, bucket = hashes[sort], of[sort], times[sort], bucket[sort].astype(np.int32)
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                blobs = [_word_blob(hashes[x:y], of[x:y], times[x:y], names[a:b], learns[a:b]) for x, y in zip(edge, np.append(edge[1:], len(bucket)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge]), pa.array([batch_id] * len(edge), pa.int64()), pa.array(blobs, pa.binary())], schema=_arrow(WORDS))
                batch_id += 1

    def reply(bucket: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        read = [_read_words(blob) for _, blob in bucket]
        hashes = np.concatenate([r[4] for r in read])
        learnt = np.concatenate([np.where(np.repeat(r[2], r[1]) > 0, r[3], 0) for r in read])
        words, of = np.unique(hashes, return_inverse=True)
        del hashes
        counts = np.bincount(of, weights=learnt, minlength=len(words))
        logs, at = np.log10(counts + SMOOTHING), 0
        kinds, total = int((counts > 0).sum()), int(counts.sum())
        for (batch, _), (rows_, runs, _, times, _) in zip(bucket, read, strict=True):
            own = of[at : at + len(times)]
            at += len(times)
            edge = np.cumsum(runs) - runs
            sums, known = np.add.reduceat(logs[own] * times, edge), np.add.reduceat(np.where(counts[own] > 0, times, 0), edge)
            yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (rows_, sums, known.astype("<i8"))), pa.array([kinds], pa.int64()), pa.array([total], pa.int64())], schema=_arrow(REPLIES))
            kinds = total = 0

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, own = None, []
        for batch in batches:
            for b, *entry in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != bucket:
                    if own:
                        yield from reply(own)
                    bucket, own = b, []
                own.append(tuple(entry))
        if own:
            yield from reply(own)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(parts: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
            names = np.concatenate([np.frombuffer(p[0], "<i8") for p in parts])
            names, of = np.unique(names, return_inverse=True)
            sums = np.bincount(of, weights=np.concatenate([np.frombuffer(p[1], "<f8") for p in parts]))
            known = np.bincount(of, weights=np.concatenate([np.frombuffer(p[2], "<i8") for p in parts])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums), pa.array(known)], schema=_arrow(SUMS))

        which, own = None, []
        for batch in batches:
            for k, *entry in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k != which:
                    if own:
                        yield close(own)
                    which, own = k, []
                own.append(tuple(entry))
        if own:
            yield close(own)

    met = rows.mapInArrow(split, WORDS).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, REPLIES)
    met = materialise(met, "words")
    kinds, total = met.agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    sums = met.select("batch", "rows", "sums", "known").repartition("batch").sortWithinPartitions("batch").mapInArrow(gather, SUMS)
    return sums.groupBy("row").agg(F.sum("log_sum").alias("log_sum"), F.sum("n_known").alias("n_known")), int(kinds), int(total)


def scores(docs: DataFrame, *, key: str, text: str, train: Column, order: int = ORDER) -> DataFrame:
    """(``key``, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``; ``train`` marks what is learnt from."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    rows = rows.withColumn("row", F.xxhash64("key", "text"))
    folder = fit(rows.where("train"), order=order)
    sums, kinds, total = unigrams(rows, row="row")
    learnt = rows.where("train").count()
    total, kinds = total + learnt, kinds + (learnt > 0)
    light = score(rows, folder, row="row", order=order)
    light = materialise(light, "scores")
    once = light.groupBy("row").agg(F.count("*").alias("copies"), F.max("words").alias("words"), F.max("score").alias("score"))
    keys = rows.select("row", "key")
    joined = keys.join(once, "row").join(sums, "row", "left")
    per_copy = F.coalesce(F.col("log_sum") / F.col("copies"), F.lit(0.0)) + math.log10(learnt + SMOOTHING)
    n_tokens = F.col("words") + 1
    known = F.coalesce(F.floor(F.col("n_known") / F.col("copies")), F.lit(0)) + int(learnt > 0)
    base = per_copy - n_tokens * math.log10(total + SMOOTHING * (kinds + 1))
    return joined.select(F.col("key").alias(key), n_tokens.alias("n_tokens"), known.cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
