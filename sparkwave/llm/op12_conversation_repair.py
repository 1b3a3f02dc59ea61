"""Query op12_conversation_repair: damaged conversations, what is wrong with them, and their cheapest repair."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair

DIGESTS = "conv string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, stripped of marks, repeated or given to the user, by a hash of their place."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = (F.crc32(F.concat_ws(":", known("conv_id"), known("turn")).cast("binary")) % 20).cast("int")
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times))).drop("col")


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` rows, which follow each other; no text is kept."""
    conv, sha = None, None
    for batch in batches:
        done = []
        for of, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
            if sha is None or of != conv:
                if sha:
                    done.append((conv, sha.hexdigest()))
                conv, sha = of, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if done:
            yield conversation_repair.batch_of(done, DIGESTS)
    if sha:
        yield conversation_repair.batch_of([(conv, sha.hexdigest())], DIGESTS)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    report, repaired = conversation_repair.repair(damaged(rows))
    hashes = repaired.mapInArrow(digests, DIGESTS).withColumnRenamed("conv", "h")
    every = rows.select("conv_id").distinct()
    same = lambda c: F.col("conv_id").cast("string").eqNullSafe(F.col(c))
    met = every.join(report, same("conv"), "left").join(hashes, same("h"), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return met.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
