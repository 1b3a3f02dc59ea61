"""Raw token-id shards with a minimal perfect hash index.

Layout of a store: ``<name>.ids`` holds a shard's token ids, little-endian and nothing else; ``<name>.idx`` holds its
index; ``manifest`` is a Parquet table with one row per shard. Shards are ranges of the key in ascending order.

The index is a minimal perfect hash over the shard's distinct keys: at each level, keys that alone hit a bit of a bit
array own that bit; the others go on to the next level. A key's slot is the number of set bits before its own. Slots
hold a 64-bit fingerprint and the key's first document, so a lookup takes a constant number of reads and refuses keys
that aren't there (but for one in 2**64).

Defined cases: null text is empty, a null key is stored first and can't be looked up, repeated keys stay adjacent and
a lookup returns all of them, an empty table gives an empty store, further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir, ship_package
from .common import mix64, open_fs, slices, texts_in, unique_name
from .tokenize import tokenizer

MAGIC = b"SWTOKIX1"
LEVELS = 40
GAMMA = 2.0
BATCH_CHARS = 4_000_000
READ_BYTES = 8 << 20
SHARDS_AT_ONCE = 100_000
_SEED = np.uint64(0x9E3779B97F4A7C15)


def key_hash(keys: pa.Array) -> np.ndarray:
    """64-bit hashes of integer keys (a bijection) or of other keys' text."""
    if pa.types.is_integer(keys.type):
        return mix64(np.asarray(keys.cast(pa.int64())).astype(np.uint64))
    return np.array([xxhash.xxh64_intdigest(str(k)) for k in keys.to_pylist()], dtype=np.uint64)


def _fingerprint(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(hashes + np.uint64(0xD1B54A32D192ED03))


def _place(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(hashes + _SEED * np.uint64(level + 1)) % np.uint64(bits)


def build_mph(hashes: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Arrays of the hash for distinct ``hashes``, and the slot of each of them."""
    sizes, words, rest, left = [], [], np.arange(len(hashes)), hashes
    home = np.full(len(hashes), -1, dtype=np.int64)
    base = 0
    for level in range(LEVELS):
        if not len(rest):
            break
        bits = max(64, -(-int(GAMMA * len(rest)) // 64) * 64)
        at = _place(left, level, bits).astype(np.int64)
        alone = np.bincount(at, minlength=bits) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        own = alone[at]
        home[rest[own]] = base + at[own]
        rest, left = rest[~own], left[~own]
        sizes.append(bits)
        base += bits
    every = np.concatenate(words) if words else np.zeros(0, dtype="<u8")
    counts = np.bitwise_count(every).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(counts)]).astype("<i8")
    slots = np.full(len(hashes), -1, dtype=np.int64)
    placed = home >= 0
    slots[placed] = _rank(every, before, home[placed])
    slots[~placed] = before[-1] + np.arange((~placed).sum())  # equal hashes of different keys, never met in practice
    arrays = {"sizes": np.array(sizes, dtype="<i8"), "words": every, "before": before, "odd": hashes[~placed].astype("<u8")}
    return arrays, slots


def _rank(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    word, bit = at // 64, (at % 64).astype(np.uint64)
    below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
    return before[word] + np.bitwise_count(below).astype(np.int64)


def find_slots(mph: dict[str, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """The slot of each hash; -1 where no level holds it. Keys that weren't indexed may get any slot."""
    slots = np.full(len(hashes), -1, dtype=np.int64)
    rest, base = np.arange(len(hashes)), 0
    for level, bits in enumerate(mph["sizes"].tolist()):
        if not len(rest):
            break
        at = base + _place(hashes[rest], level, bits).astype(np.int64)
        hit = (mph["words"][at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
        slots[rest[hit]] = _rank(mph["words"], mph["before"], at[hit])
        rest, base = rest[~hit], base + bits
    for i in rest[np.isin(hashes[rest], mph["odd"])]:
        slots[i] = mph["before"][-1] + int(np.flatnonzero(mph["odd"] == hashes[i])[0])
    return slots


def _dump(arrays: dict[str, np.ndarray], extra: dict) -> bytes:
    table, at = [], 0
    for name, a in arrays.items():
        table.append([name, a.dtype.str, len(a), at])
        at += a.nbytes
    head = json.dumps({"arrays": table, **extra}).encode()
    return MAGIC + len(head).to_bytes(8, "little") + head + b"".join(a.tobytes() for a in arrays.values())


def _load(data: bytes) -> tuple[dict[str, np.ndarray], dict]:
    if data[:8] != MAGIC:
        raise ValueError("not a token index")
    size = int.from_bytes(data[8:16], "little")
    head, base = json.loads(data[16 : 16 + size]), 16 + size
    return {n: np.frombuffer(data, dtype=d, count=c, offset=base + at) for n, d, c, at in head["arrays"]}, head


class Shard:
    """One shard's index, and keyed or sequential access to its payload."""

    def __init__(self, folder: str, name: str):
        fs, self._path = open_fs(f"{folder}/{name}.idx")
        with fs.open_input_file(self._path) as f:
            self._arrays, head = _load(f.read())
        self._fs, self._payload = fs, self._path[: -len(".idx")] + ".ids"
        self.dtype = np.dtype(head["dtype"])
        keys = pa.ipc.open_stream(self._arrays["keys"].tobytes()).read_all()
        self.keys: pa.Array = keys.column(0).combine_chunks() if len(keys) else pa.array([], keys.schema[0].type)
        self.offsets = self._arrays["offsets"]

    def find(self, keys: pa.Array) -> list[range]:
        """For each key its documents' ordinals, which are adjacent; an empty range if it isn't there."""
        known = np.asarray(keys.is_valid())
        hashes = key_hash(keys.fill_null(0) if pa.types.is_integer(keys.type) else keys)
        slots = find_slots(self._arrays, hashes)
        slots[~known] = -1
        ok = (slots >= 0) & (slots < len(self._arrays["prints"]))
        ok[ok] = self._arrays["prints"][slots[ok]] == _fingerprint(hashes[ok])
        first, count = self._arrays["first"], self._arrays["count"]
        return [range(first[s], first[s] + count[s]) if good else range(0) for s, good in zip(slots, ok, strict=True)]

    def read(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """The ids of the documents with ordinals from ``start`` to before ``stop``, in bounded reads."""
        width = self.dtype.itemsize
        with self._fs.open_input_file(self._payload) as f:
            sizes = np.diff(self.offsets[start : stop + 1]) * width
            for a, b in slices(sizes.tolist(), READ_BYTES):
                lo, hi = int(self.offsets[start + a]), int(self.offsets[start + b])
                f.seek(lo * width)
                ids = np.frombuffer(f.read((hi - lo) * width), dtype=self.dtype)
                for i in range(start + a, start + b):
                    yield ids[int(self.offsets[i]) - lo : int(self.offsets[i + 1]) - lo]


def write_shard(folder: str, batches: Iterable[pa.RecordBatch], tokenizer_path: str, end: int) -> dict | None:
    """Write one shard from batches of (key, text) in ascending key order; its manifest row, or None if it is empty."""
    tok, name = tokenizer(tokenizer_path), unique_name("")
    fs, path = open_fs(f"{folder}/{name}.ids")
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    keys, lengths = [], []
    with fs.open_output_stream(path) as out:
        for batch in batches:
            texts = texts_in(batch.column(1))
            keys.append(batch.column(0))
            for a, b in slices(map(len, texts), BATCH_CHARS):
                encoded = tok.encode(texts[a:b], end)
                lengths += [len(e) // tok.dtype.itemsize for e in encoded]
                out.write(b"".join(encoded))
    if not lengths:
        fs.delete_file(path)
        return None
    every = pa.chunked_array(keys).combine_chunks()
    offsets = np.concatenate([[0], np.cumsum(np.array(lengths, dtype="<i8"))])
    nulls = every.null_count  # they sort first
    valid = every[nulls:]
    hashes = key_hash(valid) if len(valid) else np.zeros(0, dtype=np.uint64)
    change = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, dtype=np.int64)
    mph, slots = build_mph(hashes[change])
    prints, first, count = (np.zeros(len(change), dtype=d) for d in ("<u8", "<i8", "<i8"))
    prints[slots], first[slots] = _fingerprint(hashes[change]), change + nulls
    count[slots] = np.diff(np.concatenate([change, [len(hashes)]]))
    sink = pa.BufferOutputStream()
    table = pa.table({"key": every})
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    stored = np.frombuffer(sink.getvalue(), dtype="u1")
    data = _dump({**mph, "prints": prints, "first": first, "count": count, "offsets": offsets, "keys": stored}, {"dtype": tok.dtype.str})
    with fs.open_output_stream(path[: -len(".ids")] + ".idx") as out:
        out.write(data)
    return {"name": name, "low": valid[0].as_py() if len(valid) else None, "high": valid[-1].as_py() if len(valid) else None, "n_docs": len(lengths), "n_ids": int(offsets[-1])}


def write_store(df: DataFrame, key: str, text: str, tokenizer_path: str, *, end: int = 0, folder: str | None = None) -> str:
    """Write ``df``'s texts as a token store in ascending ``key`` order; its folder.

    One shuffle by key range, as many shards as Spark reads partitions. Files of failed or repeated attempts are left
    out of the manifest.
    """
    spark = df.sparkSession
    ship_package(spark)
    folder = folder or scratch_dir(spark, "tokens")
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shards = max(1, rows.rdd.getNumPartitions())
    kind = rows.schema["key"].dataType
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("low", kind), T.StructField("high", kind), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = write_shard(folder, batches, tokenizer_path, end)
        if row:
            yield pa.RecordBatch.from_pylist([row], schema=_arrow(schema))

    rows.repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(write, schema).write.parquet(f"{folder}/manifest")
    return folder


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The shards in key order, with ``start``: the ids in all shards before. One row per shard, so one task does."""
    order = Window.orderBy(F.col("low").asc_nulls_first(), F.col("high").asc_nulls_first(), "name")
    shards = spark.read.parquet(f"{folder}/manifest")
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read_store(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """Every document of a store, found through its shard's index: key, start, n_tokens and ids (or their CRC-32).

    ``digest`` replaces ``ids`` by ``ids_crc32``, of the ids as little-endian unsigned 32-bit integers.
    """
    ship_package(spark)
    shards = manifest(spark, folder)
    key = shards.schema["low"].dataType
    last = T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.ArrayType(T.LongType()))
    schema = T.StructType([T.StructField("key", key), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), last])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["name"])
                n = len(shard.keys)
                for a in range(0, n, 4096):
                    b = min(n, a + 4096)
                    found = shard.find(shard.keys[a:b])
                    keys, starts, sizes, values = [], [], [], []
                    for i, where, ids in zip(range(a, b), found, shard.read(a, b), strict=True):
                        k = shard.keys[i].as_py()
                        if k is not None and i not in where:
                            raise ValueError(f"the index of shard {row['name']} misses key {k}")
                        keys.append(k)
                        starts.append(row["start"] + int(shard.offsets[i]))
                        sizes.append(len(ids))
                        values.append(zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((keys, starts, sizes, values), arrow, strict=True)], schema=arrow)

    count = max(1, spark.read.parquet(f"{folder}/manifest").count())
    return shards.select("name", "start").repartition(count, "name").mapInArrow(read, schema)


def lookup(keys: DataFrame, key: str, folder: str) -> DataFrame:
    """Rows (key, ids) for every document in the store with one of the keys; absent keys give no row.

    Shards hold disjoint ranges of keys, so a bisection names the shard of a key and one hash lookup finds it there.
    Ranges are broadcast, ``SHARDS_AT_ONCE`` at a time; with more shards, keys are read once for each such part.
    """
    spark = keys.sparkSession
    ship_package(spark)
    bounds = spark.read.parquet(f"{folder}/manifest").where("low is not null").select("low", "high", "name")
    kind = bounds.schema["low"].dataType
    wanted = keys.select(F.col(key).cast(kind).alias("key")).where("key is not null").distinct()
    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.LongType()))])
    named = T.StructType([T.StructField("name", T.StringType()), T.StructField("key", kind)])

    def routed(part: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(tuple(map(list, zip(*part, strict=True))))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lows, highs, names = shared.value
            for batch in batches:
                own = batch.column(0).to_pylist()
                at = [bisect_right(lows, k) - 1 for k in own]
                hit = [i >= 0 and k <= highs[i] for i, k in zip(at, own, strict=True)]
                kept = batch.column(0).filter(pa.array(hit, pa.bool_()))
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, h in zip(at, hit, strict=True) if h], pa.string()), kept], schema=_arrow(named))

        return wanted.mapInArrow(route, named)

    parts, part = [], []
    for row in bounds.orderBy("low").toLocalIterator():  # a row per shard
        part.append(tuple(row))
        if len(part) == SHARDS_AT_ONCE:
            parts, part = [*parts, routed(part)], []
    parts += [routed(part)] if part else []
    if not parts:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name = None, None
        for batch in batches:
            for n, run in groupby(enumerate(batch.column(0).to_pylist()), lambda x: x[1]):
                if n != name:
                    shard, name = Shard(folder, n), n
                places = [i for i, _ in run]
                own = batch.column(1)[places[0] : places[-1] + 1]
                for k, where in zip(own.to_pylist(), shard.find(own), strict=True):
                    for ids in shard.read(where.start, where.stop):
                        yield pa.RecordBatch.from_pylist([{"key": k, "ids": ids.astype(np.int64)}], schema=_arrow(schema))

    met = reduce(DataFrame.unionAll, parts)
    return met.repartition("name").sortWithinPartitions("name").mapInArrow(read, schema)
