"""Hard negatives: rows of other labels that an anchor scores high, but below its positives.

Vectors are taken as whole numbers, ``floor(scale * x)``, so scores are exact. Rows lie in blocks of ``BLOCK_ROWS``, and each
task scores one group of anchors against one block:

1. the ``positives`` best other rows of an anchor's own label, from each block and then from all;
2. for each anchor a full sort of the block's scores (by score, then key), in which each positive's upper limit is found by
   binary search and the next ``k`` rows of another label are read while they reach its lower limit; of these the first
   ``k`` of all blocks.

A block's rows are dealt round robin, so no key or label gathers anywhere, and an anchor brings ``k`` rows a block and
positive at most, which Spark cuts to ``k`` again before it shuffles them. All anchors meet all blocks: each block is sent
once a group of ``ANCHORS`` anchors, each group once a block.

Scores are computed as doubles where all partial sums are below 2**53, and so are exact, as 64-bit integers where they fit,
and refused beyond.

Defined cases: a null key, label or vector, an empty vector and null or non-finite components take no part; vectors of
another width than an anchor's have no score with it; repeated keys are rows, and anchors, of their own; ties go to smaller
keys; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, ship_package

BLOCK_ROWS, ANCHORS = 8192, 1024
#: Anchors that are scored against a block at a time.
AT_ONCE = 64
SCALE = 256
BLOCK = "block long, width int, keys binary, labels binary, vectors binary, asks binary"


@dataclass(frozen=True)
class Rule:
    """A negative n of a positive p: ``low * p <= 100 * n <= high * p``; how many positives and negatives are taken."""

    positives: int = 5
    k: int = 3
    low: int = 50
    high: int = 95


def usable(key: str, label: str, vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all rows (key, label, asks, vector) of a task that have the same width, in order of their keys."""
    from pyspark import TaskContext

    number, held = TaskContext.get().partitionId(), {}
    for batch in batches:
        lists = batch.column(3)
        widths = np.diff(lists.offsets.to_numpy())
        flat = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
        if np.abs(flat).max(initial=0) >= 2.0**62:
            raise ValueError("a component leaves the range of 64 bits")
        at = np.append(0, np.cumsum(widths))
        keys, labels, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for w in np.unique(widths).tolist():
            own = np.flatnonzero(widths == w)
            rows = flat[at[own][:, None] + np.arange(w)].astype(np.int64)
            held.setdefault(w, []).append((keys[own], labels[own], rows, asks[own]))
    for w, parts in held.items():
        keys, labels, rows, asks = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        columns = [pa.array([x[order].tobytes()], pa.binary()) for x in (keys, labels, rows, asks.astype(np.uint8))]
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([w], pa.int32()), *columns], names=["block", "width", "keys", "labels", "vectors", "asks"])


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys, labels, asks = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["labels"], np.int64), np.frombuffer(row["asks"], np.uint8)
    return keys, labels, np.frombuffer(row["vectors"], np.int64).reshape(len(keys), row["width"]), asks.astype(bool)


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if most < 2.0**53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return anchors @ rows.T
    raise ValueError("a score leaves the range of 64 bits")


def best_positives(scores: np.ndarray, keys: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best of the rows ``own``, ties to smaller keys; rows are in order of keys."""
    if len(own) > n:
        own = own[scores[own] >= np.partition(scores[own], -n)[-n]]
    return own[np.lexsort((own, -scores[own]))][:n]


def negatives(scores: np.ndarray, others: np.ndarray, limits: list[tuple[int, int]], k: int) -> list[np.ndarray]:
    """For each (lowest, highest) the places of the first ``k`` of the rows marked ``others`` in order of score and key."""
    order = np.lexsort((np.arange(len(scores)), -scores))
    order = order[others[order]]
    falling = -scores[order]
    found = []
    for low, high in limits:
        at = int(np.searchsorted(falling, -high))
        some = order[at : at + k]
        found.append(some[scores[some] >= low])
    return found


def limits_of(score: int, rule: Rule) -> tuple[int, int]:
    return -(-rule.low * score // 100), rule.high * score // 100


def grid(anchors: DataFrame, blocks: DataFrame, n_blocks: int, groups: int, match, schema: str) -> DataFrame:
    """What ``match`` makes of each group of anchors and each block; both sides are a few rows a group or block."""
    asking = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")))
    asked = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    return asking.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInPandas(match, schema)


def first(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key with their rank; Spark keeps no more of any key in a task before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def mine(rows: DataFrame, anchors: Column, *, key: str, vector: str, label: str, rule: Rule | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which ``anchors`` holds."""
    spark, rule = rows.sparkSession, rule or Rule()
    ship_package(spark)
    good = rows.where(usable(key, label, vector)).select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asks"), F.col(vector).cast("array<double>").alias("vector"))
    n_blocks = max(1, -(-good.count() // BLOCK_ROWS))
    blocks = materialise(good.repartition(n_blocks).mapInArrow(pack, BLOCK), "blocks")

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, labels, vectors, asks = unpack(row)
                at = np.flatnonzero(asks)
                n = len(at)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array((np.int64(row["block"]) << 32) + at), pa.array([row["width"]] * n, pa.int32()), pa.array(keys[at]), pa.array(labels[at]), pa.array([v.tobytes() for v in vectors[at]], pa.binary())], names=["anchor", "width", "key", "label", "vector"])

    asks = materialise(blocks.mapInArrow(asking, "anchor long, width int, key long, label long, vector binary"), "anchors")
    groups = max(1, -(-asks.count() // ANCHORS))
    asks = asks.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(groups)))

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple]:
        """For each anchor its row, the block's keys and labels, its scores and where it lies in the block itself."""
        for row in right.to_dict("records"):
            own = left[left["width"] == row["width"]]
            keys, labels, vectors, _ = unpack(row)
            for a in range(0, len(own), AT_ONCE):
                some = own.iloc[a : a + AT_ONCE]
                asked = np.stack([np.frombuffer(v, np.int64) for v in some["vector"]])
                for anchor, scores in zip(some.to_dict("records"), products(asked, vectors), strict=True):
                    yield anchor, keys, labels, scores, anchor["anchor"] & 0xFFFFFFFF if anchor["anchor"] >> 32 == row["block"] else -1

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 4), dtype=np.int64)]
        for anchor, keys, labels, scores, itself in scored(left, right):
            own = np.flatnonzero(labels == anchor["label"])
            best = best_positives(scores, keys, own[own != itself], rule.positives)
            out.append(np.stack([np.full(len(best), anchor["anchor"]), np.full(len(best), anchor["key"]), keys[best], scores[best]], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=["anchor", "anchor_id", "positive_id", "positive_score"])

    met = grid(asks, blocks, n_blocks, groups, nearest, "anchor long, anchor_id long, positive_id long, positive_score long")
    met = first(met, ["anchor"], [F.desc("positive_score"), F.asc("positive_id")], rule.positives)
    positives = materialise(met.withColumnRenamed("rank", "place"), "positives")
    # rule.positives at most for an anchor
    known = positives.groupBy("anchor").agg(F.collect_list(F.struct("place", "positive_id", "positive_score")).alias("positives"))
    asks = materialise(asks.join(known, "anchor"), "anchors")

    def below(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 7), dtype=np.int64)]
        for anchor, keys, labels, scores, _ in scored(left, right):
            found = negatives(scores, labels != anchor["label"], [limits_of(p["positive_score"], rule) for p in anchor["positives"]], rule.k)
            for p, at in zip(anchor["positives"], found, strict=True):
                same = [np.full(len(at), x) for x in (anchor["anchor"], p["place"], anchor["key"], p["positive_id"], p["positive_score"])]
                out.append(np.stack([*same, keys[at], scores[at]], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=["anchor", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    met = grid(asks, blocks, n_blocks, groups, below, "anchor long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    found = first(met, ["anchor", "place"], [F.desc("negative_score"), F.asc("negative_id")], rule.k)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
