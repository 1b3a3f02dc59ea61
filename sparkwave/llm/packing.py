"""Packing of token sequences by cutting-stock column generation.

A document's ids are cut into as many full sequences as they fill and one rest shorter than a sequence. The rests are the
cutting-stock problem: a linear program over patterns (multisets of rest lengths that fit a sequence) covers the
histogram of rest lengths; a knapsack dynamic programme prices new patterns; the solution is rounded down; what the
rounding leaves is covered by further patterns, the largest rest first and the others by subset sum. Patterns that fill
a sequence are used as they are. The rests of patterns that don't are laid end to end, cut at sequence borders, and what
doesn't fill a last sequence goes to sequences of a power of two, so nothing is padded.

The programme sees only the histogram, whose size is bounded by the sequence length. Documents are ranked within their
rest length, and rank and length alone give the sequence and offset of a rest; so each document is placed on its own.

Passes: (1) tokenise, write ids with each document's rank within its block; (2) count ranks by block and rest length,
solve, add the blocks' first ranks; (3) join those to the ids by block and cut.

Defined cases: null text is empty and becomes the end id alone; null or repeated keys are ordinary documents; an empty
table gives no pieces; columns other than key and text are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, ship_package
from .common import slices, texts_in, tidy, trim
from .tokenize import tokenizer

CAPACITY = 1024
#: The linear programme stops when its value is at most this much, relatively, above the bound that its duals prove.
GAP = 1e-4
#: And after so many rounds of pricing at most; rounds bound the time, not what is packed.
ROUNDS = 1000
BLOCK_ROWS = 2048
BATCH_CHARS = 1_000_000


def price(values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The best pattern for ``values[s]`` a piece of size s (-inf: none): an unbounded knapsack."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        with_s = best[c - 1 :: -1] + values[1 : c + 1] if c < capacity else best[c - 1 :: -1] + values[1:]
        s = int(np.argmax(with_s))
        if with_s[s] > best[c - 1]:
            best[c], took[c] = with_s[s], s + 1
        else:
            best[c] = best[c - 1]
    pattern, c = {}, capacity
    while c > 0:
        s = int(took[c])
        if s:
            pattern[s] = pattern.get(s, 0) + 1
        c -= max(s, 1)
    return float(best[capacity]), pattern


def start(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], float, int]]:
    """A first basis: (pattern, fractional number, the size that it uses up), greedily by ``fill``."""
    left, basis = {s: float(n) for s, n in counts.items()}, []
    while left:
        pattern = fill({s: max(1, int(n)) for s, n in left.items()}, capacity)
        times = min(left[s] / n for s, n in pattern.items())
        gone = [s for s, n in pattern.items() if left[s] - n * times <= 1e-9 * counts[s]]
        basis.append((pattern, times, gone[0]))
        basis += [({s: capacity // s}, 0.0, s) for s in gone[1:]]
        for s, n in pattern.items():
            left[s] -= n * times
        for s in gone:
            del left[s]
    return basis


def solve(counts: dict[int, int], capacity: int, gap: float = GAP, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Patterns and their fractional numbers that cover ``counts`` exactly, by the revised simplex method.

    Ends when the value is within ``gap`` of a proven bound (all ids by capacity, or the duals' bound) or after ``rounds``.
    """
    sizes = sorted(s for s, n in counts.items() if n)
    if not sizes:
        return []
    row = {s: i for i, s in enumerate(sizes)}
    basis = start({s: counts[s] for s in sizes}, capacity)
    patterns, x = [p for p, _, _ in basis], np.array([t for _, t, _ in basis])
    matrix = np.zeros((len(sizes), len(sizes)))
    for k, pattern in enumerate(patterns):
        for s, n in pattern.items():
            matrix[row[s], k] = n
    inverse = np.linalg.inv(matrix)
    values, bound = np.full(capacity + 1, -np.inf), sum(s * counts[s] for s in sizes) / capacity
    for _ in range(rounds):
        if x.sum() <= (1 + gap) * bound:
            break
        values[sizes] = inverse.sum(axis=0)
        worth, pattern = price(values, capacity)
        bound = max(bound, x.sum() / worth)
        if worth <= 1 + gap:
            break
        column = np.zeros(len(sizes))
        for s, n in pattern.items():
            column[row[s]] = n
        step = inverse @ column
        up = step > 1e-9
        ratios = np.full(len(sizes), np.inf)
        ratios[up] = np.maximum(x[up], 0) / step[up]
        out = int(np.argmin(ratios))
        x = x - ratios[out] * step
        x[out] = ratios[out]
        patterns[out] = pattern
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
    return list(zip(patterns, np.maximum(x, 0).tolist(), strict=True))


def fill(left: dict[int, int], capacity: int) -> dict[int, int]:
    """A pattern of what is left: the largest rest, and others that fill the sequence best, each as often as it is there."""
    first = max(left)
    room = capacity - first
    sizes = sorted((s for s in left if s <= room and left[s] - (s == first) > 0), reverse=True)
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for s in sizes:
        n, part = min(left[s] - (s == first), room // s), 1
        while n > 0:  # multiples by doubling
            k = min(part, n)
            steps.append((s, k, reach))
            reach |= (reach << (s * k)) & mask
            n, part = n - k, part * 2
        if reach >> room & 1:
            break
    total, pattern = reach.bit_length() - 1, {first: 1}
    for s, k, before in reversed(steps):
        if not before >> total & 1:
            pattern[s] = pattern.get(s, 0) + k
            total -= s * k
    return pattern


@dataclass
class Plan:
    """Where the rest of length s and rank r goes; arrays are indexed by slots sorted by (s, first rank)."""

    capacity: int
    patterns: list[tuple[dict[int, int], int]]
    first: list[int] = field(default_factory=list)
    slot_at: list[int] = field(default_factory=list)
    slot_rank: list[int] = field(default_factory=list)
    slot_sequence: list[int] = field(default_factory=list)
    slot_offset: list[int] = field(default_factory=list)
    ribbon_rank: list[int] = field(default_factory=list)
    ribbon_base: list[int] = field(default_factory=list)
    ribbon_sequence: int = 0
    ribbon_length: int = 0
    full_sequence: int = 0


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> Plan:
    left = {s: n for s, n in counts.items() if n and 0 < s < capacity}
    used: list[tuple[dict[int, int], int]] = []

    def use(pattern: dict[int, int], times: int) -> None:
        for s, n in pattern.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        used.append((pattern, times))

    total = dict(left)
    for pattern, x in solve(left, capacity, gap):
        times = min([int(x + 1e-9), *(left.get(s, 0) // n for s, n in pattern.items())])
        if times:
            use(pattern, times)
    while left:
        pattern = fill(left, capacity)
        use(pattern, min(left[s] // n for s, n in pattern.items()))
    full = [(p, t) for p, t in used if sum(s * n for s, n in p.items()) == capacity]
    plan, slots, taken, sequence = Plan(capacity, full), {s: [] for s in range(capacity)}, dict.fromkeys(range(capacity), 0), 0
    for pattern, times in full:
        offset = 0
        for s in sorted(pattern, reverse=True):
            for _ in range(pattern[s]):
                slots[s].append((taken[s], sequence, offset))
                taken[s] += times
                offset += s
        sequence += times
    base = 0
    for s in range(capacity):
        plan.slot_at.append(len(plan.slot_rank))
        for rank, seq, offset in slots[s]:
            plan.slot_rank.append(rank)
            plan.slot_sequence.append(seq)
            plan.slot_offset.append(offset)
        plan.ribbon_rank.append(taken[s])
        plan.ribbon_base.append(base)
        base += (total.get(s, 0) - taken[s]) * s
    plan.slot_at.append(len(plan.slot_rank))
    plan.ribbon_sequence, plan.ribbon_length = sequence, base
    tail = base % capacity
    plan.full_sequence = sequence + base // capacity + tail.bit_count()
    return plan


def place(plan: Plan, size: int, rank: int) -> list[tuple[int, int, int]]:
    """(sequence, offset, length) of each piece of the rest with this length and rank, in order."""
    from bisect import bisect_right

    if rank < plan.ribbon_rank[size]:
        i = bisect_right(plan.slot_rank, rank, plan.slot_at[size], plan.slot_at[size + 1]) - 1
        return [(plan.slot_sequence[i] + rank - plan.slot_rank[i], plan.slot_offset[i], size)]
    at = plan.ribbon_base[size] + (rank - plan.ribbon_rank[size]) * size
    end, whole, pieces = at + size, plan.ribbon_length // plan.capacity, []
    while at < end:
        if at < whole * plan.capacity:
            seq, start, width = plan.ribbon_sequence + at // plan.capacity, at // plan.capacity * plan.capacity, plan.capacity
        else:  # the last sequences: the binary digits of what is left, the largest first
            seq, start, rest = plan.ribbon_sequence + whole, whole * plan.capacity, plan.ribbon_length % plan.capacity
            width = 1 << rest.bit_length() - 1
            while at >= start + width:
                start, rest, seq = start + width, rest - width, seq + 1
                width = 1 << rest.bit_length() - 1
        n = min(end, start + width) - at
        pieces.append((seq, at - start, n))
        at += n
    return pieces


def tokenised(df: DataFrame, key: str, text: str, tokenizer_path: str, end: int, capacity: int) -> DataFrame:
    """key, ids, n, rest, n_full, block, rank (among the block's equal rests) and full_rank, written to shared scratch."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("ids", T.BinaryType())] + [T.StructField(n, T.LongType()) for n in ("n", "rest", "n_full", "block", "rank", "full_rank")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        tok, arrow = tokenizer(tokenizer_path), to_arrow_schema(schema)
        block, rows_in_block, ranks, chunks = TaskContext.get().partitionId() << 24, 0, {}, 0
        for batch in batches:
            texts = texts_in(batch.column(1))
            for a, b in slices(map(len, texts), BATCH_CHARS):
                encoded, out = tok.encode(texts[a:b], end), []
                for ids in encoded:
                    if rows_in_block == BLOCK_ROWS:
                        block, rows_in_block, ranks, chunks = block + 1, 0, {}, 0
                    n = len(ids) // tok.dtype.itemsize
                    whole, rest = divmod(n, capacity)
                    out.append((n, rest, whole, block, ranks.get(rest, 0), chunks))
                    ranks[rest], chunks, rows_in_block = ranks.get(rest, 0) + 1, chunks + whole, rows_in_block + 1
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].cast(arrow[0].type), pa.array(encoded, pa.binary()), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], schema=arrow)
            trim()  # what encoding took for a moment is several times what stays

    return materialise(rows.mapInArrow(tidy(run, keep=True), schema), "packed-ids")


PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(df: DataFrame, key: str, text: str, tokenizer_path: str, *, end: int = 0, capacity: int = CAPACITY, gap: float = GAP, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    ship_package(df.sparkSession)
    ids = tokenised(df, key, text, tokenizer_path, end, capacity)
    by_block = ids.groupBy("block", "rest").agg(F.count("*").alias("docs"), F.sum("n_full").alias("chunks"))
    by_block = materialise(by_block, "packed-counts")
    counts = {r["rest"]: r["docs"] for r in by_block.groupBy("rest").agg(F.sum("docs").alias("docs")).collect()}  # a row per length
    plan = make_plan(counts, capacity, gap)
    earlier = lambda part: Window.partitionBy(*part).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = by_block.withColumn("before", F.coalesce(F.sum("docs").over(earlier(["rest"])), F.lit(0)))
    firsts = first.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("rest", "before"))).alias("firsts"))
    whole = by_block.groupBy("block").agg(F.sum("chunks").alias("chunks"))  # one small row per block, without its map
    whole = whole.select("block", F.coalesce(F.sum("chunks").over(earlier([])), F.lit(0)).alias("full_before"))
    firsts = firsts.join(whole, "block")
    met = ids.join(firsts.hint("shuffle_hash"), "block").select("key", "ids", "n", "rest", (F.col("rank") + F.element_at("firsts", F.col("rest"))).alias("rank"), (F.col("full_rank") + F.col("full_before")).alias("full_rank"))
    fields = [T.StructField(key, ids.schema["key"].dataType), *(T.StructField(n, T.LongType()) for n in PIECE)] + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    schema = T.StructType(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            raws = batch.column(1)
            for a, b in slices((len(x) for x in raws.to_pylist()), 8 << 20):
                columns: list[list] = [[] for _ in arrow]
                for k, raw, n, rest, rank, full in zip(*(batch.column(i)[a:b].to_pylist() for i in range(6)), strict=True):
                    wide, at = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4"), 0
                    where = [(plan.full_sequence + full + i, 0, capacity) for i in range(n // capacity)]
                    for seq, offset, size in where + (place(plan, rest, rank) if rest else []):
                        data = wide[at : at + size].tobytes()
                        for c, v in zip(columns, (k, at, size, zlib.crc32(data), n, seq, offset, data), strict=False):
                            c.append(v)
                        at += size
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return met.mapInArrow(tidy(cut), schema)
