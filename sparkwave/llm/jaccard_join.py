"""Exact n-gram Jaccard self-join by universe partition and pigeonhole.

Sets of word shingles (sorted 64-bit hashes) of similar size share a scheme: a size band, and for sets that reach into
it the band above. A scheme hashes the universe of tokens into segments. Two sets with Jaccard similarity of at least 3/4
differ in at most d = floor((m + n) / 7) tokens, m and n being their sizes, so in at most d segments, and d is at most a
third of either size. Each set indexes, for its scheme:

* a subset of its segments: the keys are the contents of those that aren't empty, in one global order, rare ones first
  (a segment counts by its rarest token), and the first floor(n / 3) + 1 of them are kept. The first common key of a link
  is kept by both sets, and neither has more than d keys before it. So what only a frequent passage has in common is
  refused by position.
* or, in bands where ``allocate`` finds it cheaper, one-deletion neighbourhoods: a key for a segment's content and one for
  each content with one token less (empty contents aside). A segment then stands for min(2, its size) differences. Keys
  with a frequent token are left out here. A set with a frequent token, or whose segments can't carry its third of
  differences, takes part in the first form too; one with more than a quarter of frequent tokens only there. Two sets that
  don't meet there are a set without frequent tokens, whose keys are all here, and one that has all keys of such tokens.

Where a set's non-empty segments are too few for the first form, its single tokens are keys as well: a link of two such
sets is found by them, a link with another set by the other's segments.

Links are found in rounds. First, each set's ``SKETCH`` smallest mixed tokens propose the smallest document that shares most of
them. Then all kept keys go to buckets in compressed blobs, with each document's component so far. A bucket passes on only
keys whose documents lie in several components: the pairs that size and position can't refuse, where they are at most
``PAIRS`` times the documents, and else a row for each document that has such a pair. These lists are compared in blocks: a
task holds the bitmaps of two blocks of a list and returns the pairs that bitmaps can't refuse either; where these are more
than ``PAIRS`` times the documents, at first only the best one of each component, and what then still lies across components
when those are verified. So the rows made are in proportion to the documents of the lists, not to their squares. Whole sets decide all pairs, so the components are exact.

Defined cases: null and wordless texts have an empty set and are linked with nothing; texts of fewer than five words
have one shingle; repeated rows and equal texts share a component; a repeated key with several texts has the links of
all; rows with a null key are kept, without a component; ties have no effect; an empty table gives no rows; further
columns are ignored (kept by ``deduplicate``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, materialise_observed, ship_package
from .common import mix64, text_slices, tidy
from .components import components, merged
from .shingles import WIDTH, shingle_sets

#: Links need 100 * intersection >= 75 * union.
NUMERATOR, DENOMINATOR = 75, 100
TOKEN_LEVEL = 32  # sets below this size use single tokens
SKETCH, SKETCH_ROUNDS, BEST_ROUNDS = 12, 2, 1
BUCKET_KEYS = 1_000_000
SLICE_BYTES = 2_000_000
#: Keys that a task gathers before it deals them to buckets, and the mean number of keys in a row of a bucket, at most: Spark
#: sends a thousand rows to a worker at once.
EMIT_KEYS, ROW_KEYS = 300_000, 2048
#: A token counts as frequent by the counts of the tasks that met it in ``MIN_LOCAL`` sets; ``MAX_HOT`` such tokens are
#: broadcast, at most. Which tokens count as frequent changes costs, not results.
MIN_LOCAL, MIN_HOT = 2, 8
MAX_HOT = 200_000
#: Ids that are broadcast at once, at most, in bytes; beyond, the join is shuffled.
MAX_BROADCAST_BYTES = 32 << 20
ROLE_BYTES = 20  # of a document's role in a pair
GROUP = 512
#: Pairs for each document of a list that its bucket gives out itself, at most; documents of a block of a list; lists up
#: to ``SHORT`` documents are gone through together.
PAIRS, BLOCK, SHORT = 8, 2048, 64
CROWDED = 8
BITS = 8  # of a bitmap for each token, at least
_ONE = np.uint64(1)
_FORM = {"subset": np.uint64(0x9FB21C651E98DF25), "deletion": np.uint64(0xA24BAED4963EE407), "token": np.uint64(0xD6E8FEB86659FD93)}


def linked(both, a, b):
    return (DENOMINATOR * both >= NUMERATOR * (a + b - both)) & (both > 0)


def differences(a, b):
    """Tokens that one of two linked sets of these sizes has alone, at most."""
    return (a + b) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


@lru_cache(maxsize=None)
def allocate(upper: int) -> tuple[int, bool]:
    """Segments and whether they have deletion neighbourhoods, for sets of up to ``upper`` tokens: the cheaper form.

    A key costs one, and a key of few tokens more, as more sets without a link share it. Subset: a third of the tokens, of
    about 4/3 tokens each. Deletions: three tokens a segment, and a key for each token and segment.
    """
    crowd = lambda tokens: 1 + 60.0 / upper * np.exp(1 - tokens)  # noqa: E731  short texts repeat more
    subset = (upper / 3 + 1) * crowd(4 / 3)
    deletion = (upper / 3 + upper) * crowd(3.0) / 1.6  # they need no positions, and no frequent token has a key
    return (subset_segments(upper), False) if subset <= deletion or upper > 128 else (upper // 3, True)


def subset_segments(upper: int) -> int:
    return upper * 3 // 4


def schemes(n: int) -> list[int]:
    """Upper sizes (exclusive) of the bands in which a set of n tokens takes part."""
    own = TOKEN_LEVEL
    while own <= n:
        own *= 2
    return [own, own * 2] if n * DENOMINATOR // NUMERATOR >= own else [own]


def keys_of(tokens: np.ndarray, classes: np.ndarray, upper: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set in a scheme and the number of its keys before each; classes: of frequency, 0 for rare tokens."""
    if upper == TOKEN_LEVEL:
        return _by_token(tokens, classes, upper)
    n, (_, deletion) = len(tokens), allocate(upper)
    found, frequent, short = [], int(np.count_nonzero(classes)), False
    if deletion:
        keys, short = _by_deletion(tokens, classes, upper)
        if 4 * frequent <= n:
            found.append((keys, np.zeros(len(keys), dtype=np.int64)))
    if not deletion or frequent or short:
        keys, rank, few = _by_subset(tokens, classes, upper)
        found.append((keys, rank))
        if few:
            found.append(_by_token(tokens, classes, upper))
    return np.concatenate([k for k, _ in found]), np.concatenate([r for _, r in found])


def _segments(tokens: np.ndarray, upper: int, count: int, form: np.uint64) -> tuple[np.ndarray, ...]:
    """For the non-empty segments of a set: order of its tokens, first places, sizes, names, and the mixed tokens in order."""
    with np.errstate(over="ignore"):
        at = (mix64(tokens ^ (np.uint64(upper) * form)) % np.uint64(count)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        at, mixed = at[order], mix64(tokens[order])
        edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        return order, edge, np.diff(np.append(edge, len(at))), (at[edge].astype(np.uint64) + _ONE) * form + np.uint64(upper), mixed


def _by_deletion(tokens: np.ndarray, classes: np.ndarray, upper: int) -> tuple[np.ndarray, bool]:
    """Contents and contents less a token, those with a frequent token aside; whether they carry too few differences."""
    order, edge, sizes, names, mixed = _segments(tokens, upper, allocate(upper)[0], _FORM["deletion"])
    hot = (classes[order] > 0).astype(np.int64)
    with np.errstate(over="ignore"):
        sums, hots = np.add.reduceat(mixed, edge), np.add.reduceat(hot, edge)
        several = np.repeat(sizes > 1, sizes) & (np.repeat(hots, sizes) - hot == 0)
        less = (np.repeat(sums, sizes) - mixed)[several]
        keys = np.concatenate([mix64(sums ^ mix64(names))[hots == 0], mix64(less ^ mix64(np.repeat(names, sizes)[several]))])
    return keys, int(np.minimum(sizes, 2).sum()) < len(tokens) // 3 + 1


def _by_subset(tokens: np.ndarray, classes: np.ndarray, upper: int) -> tuple[np.ndarray, np.ndarray, bool]:
    order, edge, _, names, mixed = _segments(tokens, upper, subset_segments(upper), _FORM["subset"])
    with np.errstate(over="ignore"):
        contents = mix64(np.add.reduceat(mixed, edge) ^ mix64(names))
    need = len(tokens) // 3 + 1
    return *_first(contents, np.minimum.reduceat(classes[order], edge), need), len(contents) < need


def _by_token(tokens: np.ndarray, classes: np.ndarray, upper: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return _first(mix64(tokens + np.uint64(upper) * _FORM["token"]), classes, len(tokens) // 3 + 1)


def _first(contents: np.ndarray, classes: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    rank = (contents >> np.uint64(6)) | (classes.astype(np.uint64) << np.uint64(58))
    order = np.argsort(rank, kind="stable")[:need]
    return contents[order], np.arange(len(order))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


SETS = T.StructType([T.StructField("frequent", T.BooleanType()), T.StructField("doc", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType())])


def describe(docs: DataFrame, width: int) -> DataFrame:
    """A row (doc, n, digest, sketch and bitmap of the set) per document, and rows (token, count) of tokens that a task meets often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, every, size = _arrow(SETS), [], 0
        counts: list[tuple[np.ndarray, np.ndarray]] = []

        def fold() -> None:
            tokens, n = np.unique(np.concatenate(every), return_counts=True)
            counts.append((tokens[n > 1], n[n > 1]))

        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(1), SLICE_BYTES):
                sets = list(shingle_sets(texts, width))
                every += [s for s in sets if len(s)]
                size += sum(map(len, sets))
                if size > 2_000_000:
                    fold()
                    every, size = [], 0
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                sketches = [np.partition(mix64(s), SKETCH - 1)[:SKETCH].view(np.int64) if len(s) > SKETCH else mix64(s).view(np.int64) for s in sets]
                bits = [_bitmap(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([False] * len(sets)), batch.column(0)[lo:hi], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.array(bits, pa.binary())], schema=arrow)
        if every:
            fold()
        if counts:
            tokens, inverse = np.unique(np.concatenate([t for t, _ in counts]), return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate([n for _, n in counts])).astype(np.int64)
            tokens, total = tokens[total >= MIN_LOCAL], total[total >= MIN_LOCAL]
            for a in range(0, len(tokens), 10_000):
                part = tokens[a : a + 10_000].view(np.int64)
                none = pa.nulls(len(part), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([True] * len(part)), pa.array(part), pa.array(total[a : a + 10_000]), none, pa.nulls(len(part), pa.list_(pa.int64())), none], schema=arrow)

    return docs.mapInArrow(tidy(run), SETS)


def keyed(docs: DataFrame, width: int, buckets: int, hot) -> DataFrame:
    """Rows (bucket, blob): the kept keys of each set of docs (doc, text, component, gone), once for equal sets of a task.

    A set with the digest ``gone`` is left out: an equal one of the same component is another document's, and has the same links.
    """
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("blob", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, met = _arrow(schema), set()
        frequent, class_of = np.frombuffer(hot.value[0], dtype=np.uint64), np.frombuffer(hot.value[1], dtype=np.uint8)
        found, ids, sizes, parts, total = [], [], [], [], 0
        most = min(EMIT_KEYS, ROW_KEYS * buckets)

        def flush() -> pa.RecordBatch:
            every, before = np.concatenate([k for k, _ in found]), np.concatenate([r for _, r in found])
            of = np.repeat(np.arange(len(found), dtype=np.int64), [len(k) for k, _ in found])
            bucket = (every % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")  # documents stay in order within a bucket
            every, before, of, bucket = every[order], np.minimum(before[order], 65535).astype("<u2"), of[order], bucket[order]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            blobs = []
            for a, b in zip(edge, np.append(edge[1:], len(every)), strict=True):
                docs_, runs = np.unique(of[a:b], return_counts=True)
                head = np.array([len(docs_)], dtype="<i8").tobytes() + np.array(ids, dtype="<i8")[docs_].tobytes() + np.array(parts, dtype="<i8")[docs_].tobytes() + np.array(sizes, dtype="<i4")[docs_].tobytes() + runs.astype("<i4").tobytes()
                blobs.append(head + before[a:b].tobytes() + (every[a:b] >> np.uint64(16)).view("u1").reshape(-1, 8)[:, :6].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(bucket[edge], pa.int32()), pa.array(blobs, pa.binary())], schema=arrow)

        for batch in batches:
            ids_here, parts_here, gone_here = (batch.column(i).to_pylist() for i in (0, 2, 3))
            sets = (s for _, _, texts in text_slices(batch.column(1), SLICE_BYTES) for s in shingle_sets(texts, width))
            for doc, part, gone, tokens in zip(ids_here, parts_here, gone_here, sets, strict=True):
                digest = xxhash.xxh3_128_digest(tokens.tobytes())
                if doc is None or not len(tokens) or digest == gone or digest in met:
                    continue
                met.add(digest)
                classes = _classes(tokens, frequent, class_of)
                for upper in schemes(len(tokens)):
                    keys = keys_of(tokens, classes, upper)
                    found.append(keys)
                    ids.append(doc)
                    parts.append(part)
                    sizes.append(len(tokens))
                    total += len(keys[0])
                if total > most:
                    yield flush()
                    found, ids, sizes, parts, total = [], [], [], [], 0
        if found:
            yield flush()

    return docs.mapInArrow(tidy(run), schema)


def _classes(tokens: np.ndarray, frequent: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(tokens), dtype=np.uint8)
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    return np.where(frequent[at] == tokens, class_of[at], 0).astype(np.uint8)


CANDIDATES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("list", T.LongType()), T.StructField("many", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("before", T.IntegerType())])


def _read_blob(blob: bytes | pa.Buffer) -> tuple[np.ndarray, ...]:
    """Keys and numbers of keys before them; and of the documents whose keys follow each other ids, components, set sizes and
    numbers of keys."""
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    docs, parts = np.frombuffer(blob, "<i8", n, 8), np.frombuffer(blob, "<i8", n, 8 + 8 * n)
    sizes, runs = np.frombuffer(blob, "<i4", n, 8 + 16 * n), np.frombuffer(blob, "<i4", n, 8 + 20 * n)
    total, at = int(runs.sum()), 8 + 24 * n
    keys = np.zeros((total, 8), dtype="u1")
    keys[:, :6] = np.frombuffer(blob, "u1", 6 * total, at + 2 * total).reshape(-1, 6)
    return keys.view("<u8").ravel(), np.frombuffer(blob, "<u2", total, at), docs, parts, sizes, runs


def _may_meet(n, m, before_n, before_m):
    """Whether sets of these sizes can be linked with so many keys before their first common one."""
    return (DENOMINATOR * np.minimum(n, m) >= NUMERATOR * np.maximum(n, m)) & (np.maximum(before_n, before_m) <= differences(n, m))


def _bucket_rows(blobs: list[bytes | pa.Buffer]) -> Iterator[pa.RecordBatch]:
    keys, before, docs, parts, sizes, counts = (np.concatenate(x) for x in zip(*map(_read_blob, blobs), strict=True))
    blobs.clear()
    of = np.repeat(np.arange(len(docs), dtype=np.int32), counts)
    # most keys are of one component: they go before anything else is laid out by key
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    own = parts[of[order]]
    several = np.minimum.reduceat(own, edge) != np.maximum.reduceat(own, edge)
    del own
    left = np.repeat(several, np.diff(np.append(edge, len(keys))))
    keys, order = keys[left], order[left]
    if not len(keys):
        return
    of, before = of[order], before[order].astype(np.int32)
    docs, sizes, parts = docs[of], sizes[of], parts[of]

    def keep(which: np.ndarray) -> None:
        nonlocal keys, docs, sizes, parts, before
        keys, docs, sizes, parts, before = keys[which], docs[which], sizes[which], parts[which], before[which]

    def runs() -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return edge, np.diff(np.append(edge, len(keys)))

    keep(np.lexsort((before, docs, keys)))
    keep(np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])]))
    edge, count = runs()
    arrow = _arrow(CANDIDATES)
    sparse, met = _pairs_of_sparse(edge, count, docs, sizes, parts, before)
    a, b = np.unique(np.sort(docs[sparse], axis=0), axis=1)
    crowd = _crowds(a, b)
    inside = crowd >= 0
    if inside.any():
        at = np.unique(sparse)
        at = at[np.isin(docs[at], a[inside]) | np.isin(docs[at], b[inside])]
        members, of_member = np.unique(np.concatenate([a[inside], b[inside]]), return_index=True)
        group = np.concatenate([crowd[inside], crowd[inside]])[of_member]
        with np.errstate(over="ignore"):
            named = np.zeros(int(group.max()) + 1, dtype=np.uint64)
            np.add.at(named, group, mix64(members.view(np.uint64)))
        group_at = group[np.searchsorted(members, docs[at])]
        order = np.lexsort((before[at], sizes[at], docs[at]))
        at, group_at = at[order], group_at[order]
        first = np.concatenate([[True], (docs[at][1:] != docs[at][:-1]) | (sizes[at][1:] != sizes[at][:-1])])
        at, group_at = at[first], group_at[first]
        yield from _list_rows(named.view(np.int64)[group_at], np.bincount(group)[group_at].astype(np.int32), docs[at], sizes[at], before[at])
        a, b = a[~inside], b[~inside]
    for lo in range(0, len(a), 10_000):
        some = [pa.array(x[lo : lo + 10_000]) for x in (a, b)]
        yield pa.RecordBatch.from_arrays([*some, *(pa.nulls(len(some[0]), f.type) for f in list(arrow)[2:])], schema=arrow)
    keep(met)
    if not len(keys):
        return
    edge, count = runs()
    with np.errstate(over="ignore"):  # lists of the same documents become one; so would lists that met in a hash
        name = np.add.reduceat(mix64(docs.view(np.uint64)), edge).view(np.int64)
    name, many = np.repeat(name, count), np.repeat(count, count)
    order = np.lexsort((before, docs, many, name))
    keep(order)
    name, many = name[order], many[order].astype(np.int32)
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (many[1:] != many[:-1]) | (docs[1:] != docs[:-1])])
    keep(new)
    yield from _list_rows(name[new], many[new], docs, sizes, before)


def _list_rows(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of lists from (list, many, doc, n, before)."""
    arrow = _arrow(CANDIDATES)
    for lo in range(0, len(columns[0]), 10_000):
        part = [pa.array(x[lo : lo + 10_000]) for x in columns]
        none = pa.nulls(len(part[0]), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, *part], schema=arrow)


def _crowds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of a bucket's pairs the number of its crowd, or -1: documents that these pairs connect, with more pairs than
    documents and at least one in ``CROWDED`` of all that they could have. A crowd's list has a row for each document, and
    is the same one in other buckets that connect the same documents; its pairs would come again from most of them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, label[i], low)
        np.minimum.at(after, label[j], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    many, pairs = np.bincount(label, minlength=len(ids)), np.bincount(label[i], minlength=len(ids))
    crowded = (pairs > many) & (many <= BLOCK) & (many * (many - 1) <= 2 * CROWDED * pairs)
    return np.where(crowded[label[i]], label[i], -1)


def _pairs_of_sparse(edge: np.ndarray, count: np.ndarray, docs: np.ndarray, sizes: np.ndarray, parts: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of lists in which at most ``PAIRS`` times their number of documents may meet; for the
    other lists, marks for the documents that may meet any."""
    may = lambda i, j: (parts[i] != parts[j]) & _may_meet(sizes[i], sizes[j], before[i], before[j])
    of, found, dense, met = np.repeat(np.arange(len(count)), count), [], count > BLOCK, np.zeros(len(docs), dtype=bool)
    met[dense[of]] = True  # their documents are dealt to several tasks
    at = np.flatnonzero(np.repeat(count <= SHORT, count))
    for step in range(1, SHORT):
        at = at[at + step < edge[of[at]] + count[of[at]]]
        ok = may(at, at + step)
        found.append(np.stack([at[ok], at[ok] + step]))
    for k in np.flatnonzero((count > SHORT) & ~dense):
        own = np.arange(edge[k], edge[k] + count[k])
        for lo in range(0, len(own), 256):
            i, j = np.nonzero(may(own[lo : lo + 256, None], own[None, :]) & (own[lo : lo + 256, None] < own[None, :]))
            found.append(np.stack([own[lo + i], own[j]]))
    pairs = np.concatenate(found, axis=1)
    dense |= np.bincount(of[pairs[0]], minlength=len(count)) > PAIRS * count
    in_dense = dense[of[pairs[0]]]
    met[pairs[:, in_dense].ravel()] = True
    return pairs[:, ~in_dense], met


def candidates(blobs: DataFrame, buckets: int) -> DataFrame:
    """Rows (a, b) of lists with few pairs, and rows (list, many, doc, n, before) of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, own = None, []
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != bucket:
                    if own:
                        yield from _bucket_rows(own)
                    bucket, own = k, []
                own.append(blob.as_buffer())  # no copy
        if own:
            yield from _bucket_rows(own)

    return blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), CANDIDATES)


def _bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each token's hash below a power of two, from ``BITS`` times the number of tokens on."""
    size = max(64, 1 << (BITS * len(tokens) - 1).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[(mix64(tokens) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: list[bytes]) -> np.ndarray:
    """A matrix of bitmaps, each with bits for hashes below the smallest power among them."""
    words = min(map(len, bits)) // 8
    return np.stack([np.bitwise_or.reduce(np.frombuffer(b, "<u8").reshape(-1, words), axis=0) for b in bits])


def most_common(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Common tokens at most, for rows of bitmaps: a bit that one alone has stands for a token that one set alone has."""
    return np.minimum(n - np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64), m - np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64))


def block_pairs(x: dict, y: dict | None, most_pairs: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs (a < b) of documents of two blocks, or of one, in different components, that nothing refuses as yet.

    Beyond ``most_pairs``, for each component only the pair whose bitmaps have most in common; then the last value is True.
    """
    some = False
    bits = _folded(x["bits"] + (y["bits"] if y else []))
    left, right = bits[: len(x["doc"])], bits[len(x["doc"]) :] if y else bits
    y, same = y or x, y is None
    step, found = max(1, 250_000 // max(1, len(y["doc"]))), []
    for lo in range(0, len(left), step):
        row = {k: x[k][lo : lo + step, None] for k in ("doc", "n", "before", "component")}
        ok = (row["component"] != y["component"]) & _may_meet(row["n"], y["n"], row["before"], y["before"])
        i, j = np.nonzero(ok & (row["doc"] < y["doc"]) if same else ok)
        most = max(1, 500_000 // bits.shape[1])
        for at in range(0, len(i), most):
            u, v = i[at : at + most] + lo, j[at : at + most]
            n, m = x["n"][u], y["n"][v]
            both = most_common(left[u], right[v], n, m)
            may = linked(both, n, m)
            u, v, share = u[may], v[may], (both / (n + m - both))[may]
            found.append([x["doc"][u], y["doc"][v], x["component"][u], y["component"][v], share])
        if some or sum(len(f[0]) for f in found) > most_pairs:
            some, found = True, [_best_of(*map(np.concatenate, zip(*found, strict=True)))]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), False
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return np.minimum(a, b), np.maximum(a, b), some


def _best_of(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort((b, a, -share))
    first = np.union1d(order[np.unique(of_a[order], return_index=True)[1]], order[np.unique(of_b[order], return_index=True)[1]])
    return [z[first] for z in (a, b, of_a, of_b, share)]


FOUND = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("list", T.LongType()), T.StructField("many", T.IntegerType())])
PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def in_lists(lists: DataFrame, bits: DataFrame, within: DataFrame, whole: bool) -> DataFrame:
    """(a, b) across components that sizes, positions and bitmaps can't refuse, from blocks of the lists' documents.

    Unless ``whole``, a block gives at most ``PAIRS`` for each document, or the best of each component and a row (list,
    many) of its list, which has to be gone through again.
    """
    placed = _placed(lists, within, "doc").join(bits, "doc")
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("list", "many", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc", "n", "before", "component", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, group, own = _arrow(FOUND), None, []

        def pairs() -> Iterator[pa.RecordBatch]:
            sides = {}
            for row in own:
                sides.setdefault(row[0], []).append(row[1:])
            sides = [{k: list(c) if k == "bits" else np.array(c, dtype=np.int64) for k, c in zip(("doc", "n", "before", "component", "bits"), zip(*rows, strict=True), strict=True)} for rows in sides.values()]
            if len(sides) == 2 or sides and group[2] == group[3]:
                a, b, some = block_pairs(sides[0], sides[1] if len(sides) == 2 else None, np.inf if whole else PAIRS * len(own))
                for lo in range(0, len(a), 10_000):
                    n = len(a[lo : lo + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + 10_000]), pa.array(b[lo : lo + 10_000]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], schema=arrow)
                if some:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([group[0]], pa.int64()), pa.array([group[1]], pa.int32())], schema=arrow)

        for batch in batches:
            for *key, block, doc, n, before, component, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != group:
                    yield from pairs()
                    group, own = key, []
                own.append((block, doc, n, before, component, raw))
        yield from pairs()

    keys = ["list", "many", "low", "high"]
    return materialise(placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), FOUND).distinct(), "listed")


def _counted(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``rows``, written, and their number: writing counts them."""
    rows, seen = materialise_observed(rows, name, F.count("*").alias("rows"))
    return rows, seen.get("rows", 0)


def _fit(rows: int, width: int) -> bool:
    return rows * width <= MAX_BROADCAST_BYTES


def _written(rows: DataFrame, name: str, width: int) -> tuple[DataFrame, DataFrame]:
    """``rows``, written, of ``width`` bytes each; and the same to be broadcast, if they fit."""
    rows, many = _counted(rows, name)
    return rows, F.broadcast(rows) if _fit(many, width) else rows


def _small(rows: DataFrame, name: str, width: int, most: int | None = None) -> DataFrame:
    """The same to be broadcast, if they fit; ``most``: known to be no more rows, so that they need not be written."""
    return F.broadcast(rows) if most is not None and _fit(most, width) else _written(rows, name, width)[1]


def _of(rows: DataFrame, pairs: DataFrame, number: int) -> DataFrame:
    """The ``rows`` (doc, ...) of the documents of so many written pairs."""
    needed = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    return rows.join(_small(needed, "needed", 8, 2 * number), "doc", "left_semi")


def compared(pairs: DataFrame, number: int, forms: DataFrame, holds) -> DataFrame:
    """Those of so many written pairs (a, b) for which ``holds`` of rows (n, form) of both documents in forms (doc, n, form).

    The pairs of one ``a`` meet in groups of about ``GROUP`` b's. A group streams: the rows of ``a`` stay, the others pass.
    """
    salted = pairs.withColumn("part", F.lit(0))
    if number > GROUP:
        many = pairs.groupBy("a").count().where(F.col("count") > GROUP).select("a", F.ceil(F.col("count") / GROUP).alias("parts"))
        salted = pairs.join(_small(many, "many", 16, number // GROUP), "a", "left")
        salted = salted.select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    roles = salted.select(F.col("b").alias("doc"), F.col("a").alias("rep"), "part").union(salted.select(F.col("a").alias("doc"), F.col("a").alias("rep"), "part").distinct())
    met = forms.join(_small(roles, "roles", ROLE_BYTES, 2 * number), "doc").select("rep", "part", "doc", "n", "form")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, group, own, found = _arrow(PAIR), None, [], set()
        for batch in batches:
            rows = []
            for rep, part, doc, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (rep, part) != group:
                    group, own, found = (rep, part), [], set()
                if doc == rep:
                    own.append((n, raw))  # a repeated id has several sets
                elif doc not in found and any(holds(*o, n, raw) for o in own):
                    found.add(doc)
                    rows.append((rep, doc))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    met = met.repartition("rep", "part").sortWithinPartitions("rep", "part", (F.col("doc") != F.col("rep")))
    return met.mapInArrow(tidy(compare), PAIR)  # each pair once, as it lies in one group


def _may_link(n: int, x: bytes, m: int, y: bytes) -> bool:
    """False only if the sets can't link."""
    a, b = _folded([x, y])
    return bool(linked(most_common(a, b, n, m), n, m))


def _do_link(n: int, x: bytes, m: int, y: bytes) -> bool:
    a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    return bool(linked(_common(a, b), n, m))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def verify(pairs: DataFrame, number: int, docs: DataFrame, width: int) -> DataFrame:
    """Those of so many written pairs (a, b) that are links, by their whole sets."""
    if not number:
        return pairs
    texts = _of(docs, pairs, number).select("doc", "text")
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("n", T.LongType()), T.StructField("form", T.BinaryType())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(1), SLICE_BYTES):
                own = list(shingle_sets(texts, width))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([len(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], schema=arrow)

    return materialise(compared(pairs, number, texts.mapInArrow(tidy(sets), schema), _do_link), "verified")


def join(df: DataFrame, key: str, text: str, *, width: int = WIDTH) -> DataFrame:
    """One row (``key``, n_shingles, component_id) per row of ``df``; ``key`` is an integer column."""
    spark = df.sparkSession
    ship_package(spark)
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    described = materialise(describe(docs, width), "sets")
    rows = described.where("not frequent").select("doc", "n", "digest")
    buckets = max(12, -(-int(rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // (2 * BUCKET_KEYS)))  # half the tokens, about, become keys
    hot = spark.sparkContext.broadcast(frequent_tokens(described))
    # equal sets are one node, named by their smallest document
    classes = rows.where("digest is not null and doc is not null").groupBy("digest").agg(F.min("doc").alias("node"), F.count("*").alias("many"))
    classes = materialise(classes.where("many > 1").select("digest", "node"), "classes")
    gone, small = _written(rows.where("doc is not null").join(classes, "digest").where("doc <> node").select("doc", "digest", "node").distinct(), "gone", 32)
    nodes = described.where("not frequent and digest is not null and doc is not null").join(small, ["doc", "digest"], "left_anti")
    nodes = nodes.select("doc", "n", "sketch", F.col("bits").alias("form"))
    within = components(gone.select(F.col("doc").alias("a"), F.col("node").alias("b")))
    asked, done = materialise(by_sketch(nodes), "asked"), None
    for _ in range(SKETCH_ROUNDS):
        left = asked if done is None else _across(asked, within).join(done, ["a", "b"], "left_anti")
        pairs, number = _counted(_best(left), "pairs")
        links = verify(*possible(pairs, number, nodes), docs, width)
        done = pairs if done is None else done.union(pairs)
        within = merged(within, links)
    # a repeated key with several texts comes once for each of its digests that are gone, so none of its sets is left out for good
    marks = within.join(gone.select("doc", F.col("digest").alias("gone")), "doc", "left")
    placed = docs.join(_small(marks, "marks", 32), "doc", "left").select("doc", "text", F.coalesce("component", "doc").alias("component"), "gone")
    blobs = keyed(placed, width, buckets, hot)
    found = materialise(candidates(blobs, buckets), "candidates")
    lists = found.where("list is not null").groupBy("list", "many", "doc", "n").agg(F.min("before").alias("before"))
    lists = materialise(lists, "lists")
    short, _ = possible(*_counted(found.where("a is not null").select("a", "b").distinct().join(done, ["a", "b"], "left_anti"), "short"), nodes)
    bits = nodes.join(_small(lists.select("doc").distinct(), "listed", 8), "doc", "left_semi")
    bits = materialise(bits.select("doc", F.col("form").alias("bits")), "bits")
    for step in range(BEST_ROUNDS + 1):
        listed = in_lists(lists, bits, within, step == BEST_ROUNDS)
        again = listed.where("a is null").select("list", "many").distinct()
        last = again.isEmpty()
        pairs = listed.where("a is not null").select("a", "b").union(_across(short, within) if last else _best(_across(short, within)))
        pairs, number = _counted(pairs.distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        links = verify(pairs, number, docs, width)
        done, within = done.union(pairs), merged(within, links)
        if last:
            break
        lists = materialise(lists.join(again, ["list", "many"], "left_semi"), "lists")
    named = rows.join(classes, "digest", "left").select("doc", "n", F.coalesce("node", "doc").alias("node"))
    out = named.join(within.withColumnRenamed("doc", "node"), "node", "left")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "node")).alias("component_id"))


def frequent_tokens(described: DataFrame) -> tuple[bytes, bytes]:
    """Sorted tokens of at least ``MIN_HOT`` counts, ``MAX_HOT`` at most, and their class: the logarithm of the count."""
    top = described.where("frequent").groupBy("doc").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_HOT).orderBy(F.desc("n"), "doc").limit(MAX_HOT).collect()
    tokens = np.array([r[0] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order].tobytes(), np.array([int(r[1]).bit_length() for r in top], dtype=np.uint8)[order].tobytes()


def possible(pairs: DataFrame, number: int, nodes: DataFrame) -> tuple[DataFrame, int]:
    """Those of so many written pairs whose bitmaps can't refuse a link, written, and their number."""
    if not number:
        return pairs, 0
    forms = nodes if _fit(2 * number, ROLE_BYTES) else _of(nodes, pairs, number)  # a broadcast of roles leaves out the others
    return _counted(compared(pairs, number, forms, _may_link), "possible")


def by_sketch(nodes: DataFrame) -> DataFrame:
    """(a, b, keys): for each token of a sketch, its smallest document with each of its others of similar size."""
    tokens = nodes.select("doc", "n", F.explode("sketch").alias("token"))
    first = materialise(tokens.groupBy("token").agg(F.min(F.struct("doc", "n")).alias("first"), F.count("*").alias("many")).where("many > 1").select("token", "first"), "first")
    asked = tokens.join(first, "token").where("doc <> first.doc").where(DENOMINATOR * F.least("n", "first.n") >= NUMERATOR * F.greatest("n", "first.n"))
    return asked.groupBy(F.col("first.doc").alias("a"), F.col("doc").alias("b")).agg(F.count("*").alias("keys"))


def _best(pairs: DataFrame) -> DataFrame:
    """For each b the a that most keys ask for, the smallest of several."""
    keys = F.col("keys") if "keys" in pairs.columns else F.lit(1)
    return pairs.groupBy("b").agg(F.max_by("a", F.struct(keys, -F.col("a"))).alias("a")).select("a", "b")


def _placed(rows: DataFrame, within: DataFrame, column: str) -> DataFrame:
    """``rows`` with the component of the document in ``column``: its own id where it has no link."""
    own = within.select(F.col("doc").alias("_doc"), F.col("component").alias("_component"))
    return rows.join(own, F.col(column) == F.col("_doc"), "left").withColumn("component", F.coalesce("_component", column)).drop("_doc", "_component")


def _across(pairs: DataFrame, within: DataFrame) -> DataFrame:
    """The pairs whose documents lie in different components."""
    both = _placed(_placed(pairs, within, "a").withColumnRenamed("component", "of_a"), within, "b")
    return both.where("of_a <> component").select(*pairs.columns)


def deduplicate(df: DataFrame, key: str, text: str, *, width: int = WIDTH) -> DataFrame:
    """The rows of ``df`` whose key names their component, with the same columns: one document of each group stays."""
    found = join(df, key, text, width=width)
    gone = found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_gone")).distinct()
    return df.join(_small(gone, "gone", 8), F.col(f"`{key}`").cast("long") == F.col("_gone"), "left_anti")
