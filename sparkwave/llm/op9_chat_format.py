"""Query op9_chat_format: conversations written as raw transcripts, their roles recovered and rendered."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, ship_package
from . import transcripts

#: How each transcript style marks system, user and assistant, and whether a blank line stands between turns.
STYLES = [
    (("System: ", "User: ", "Assistant: "), False),
    (("Instructions: ", "Human: ", "AI: "), True),
    (("### System\n", "### User\n", "### Assistant\n"), True),
    (("<|system|>\n", "<|user|>\n", "<|assistant|>\n"), False),
    (("[SYSTEM] ", "[USER] ", "[BOT] "), False),
    (("**Context:** ", "**Q:** ", "**A:** "), True),
]
#: Rows of a conversation, in order of turn, that make one transcript, at most: longer ones are several transcripts.
PART_TURNS = 256
#: Of so many turns after a transcript's first, one has no marker; a blank line stands before it.
UNMARKED = 8


def _choose(style: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), style + 1)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``, their number from 0 within conv_id by turn, role and text, however many a conv_id has.

    All rows are sorted by range, equal ones dealt by their place in the input, and counted in each partition. Only a
    partition's first conv_id can have begun before it, so a row per partition goes to the driver.
    """
    ship_package(rows.sparkSession)
    order = ["conv_id", "turn", "role", "text", "_at"]
    ordered = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_at")
    schema = T.StructType([*ordered.schema, *(T.StructField(n, T.LongType()) for n in ("rank", "_slice", "_run"))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here, run, rank, last = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            ranks, runs = [], []
            for conv in batch.column(0).to_pylist():
                if run < 0 or conv != last:
                    run, rank, last = run + 1, 0, conv
                ranks.append(rank)
                runs.append(run)
                rank += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks, pa.int64()), pa.array([here] * len(ranks), pa.int64()), pa.array(runs, pa.int64())], names=schema.names)

    counted = materialise(ordered.mapInArrow(count, schema), "chat-rows")
    last = F.max_by(F.struct("conv_id", "rank"), F.struct("_run", "rank"))
    ends = counted.groupBy("_slice").agg(F.min_by(F.struct("conv_id"), F.struct("_run", "rank")).alias("first"), last.alias("last"), F.max("_run").alias("runs"))
    before, offsets, conv = 0, [], None
    for r in sorted(ends.collect(), key=lambda r: r["_slice"]):
        goes_on = bool(offsets) and r["first"]["conv_id"] == conv
        offsets.append((r["_slice"], before if goes_on else 0))
        conv, before = r["last"]["conv_id"], r["last"]["rank"] + 1 + (before if goes_on and r["runs"] == 0 else 0)
    offsets = rows.sparkSession.createDataFrame(offsets, "_slice long, _before long")
    met = counted.join(F.broadcast(offsets), "_slice", "left")
    return met.withColumn("rank", F.col("rank") + F.when(F.col("_run") == 0, F.col("_before")).otherwise(0)).select(*rows.columns, "rank")


def as_transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, part, transcript, truth) from (conv_id, turn, role, text); truth has role and begins of each line."""
    rows = numbered(turns.select("conv_id", F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumn("part", F.floor(F.col("rank") / PART_TURNS))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    mark = F.when(F.col("role") == "system", _choose(style, [m[0] for m, _ in STYLES])).when(F.col("role") == "assistant", _choose(style, [m[2] for m, _ in STYLES])).otherwise(_choose(style, [m[1] for m, _ in STYLES]))
    gap = F.element_at(F.array(*(F.lit(b) for _, b in STYLES)), style + 1)
    bare = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(UNMARKED)) == 0) & (F.pmod(F.col("rank"), F.lit(PART_TURNS)) > 0)
    piece = F.concat(F.when(gap | bare, F.lit("\n")).otherwise(F.lit("")), F.when(bare, F.lit("")).otherwise(mark), F.col("text"))
    entry = F.struct("rank", "role", piece.alias("piece"))
    grouped = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(entry)).alias("turns"))
    return grouped.select("conv_id", "part", F.array_join(F.transform("turns", lambda t: t["piece"]), "\n").alias("transcript"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["piece"].alias("piece"))).alias("truth"))


def _states(truth: list) -> list[tuple[str, bool]]:
    states = []
    for role, piece in truth:
        lines = [line for line in piece.split("\n") if line.strip()]
        states += [(role if role in transcripts.ROLES else "user", i == 0) for i in range(len(lines))]
    return states


def fit(rows: DataFrame) -> transcripts.Model:
    """From at most ``MAX_TRAINING`` transcripts whose crc32(conv_id as text) mod 3 is not 1, those of smallest hash."""
    learn = rows.where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 3 != 1)
    sample = learn.orderBy(F.xxhash64("transcript"), "conv_id", "part").limit(transcripts.MAX_TRAINING).collect()
    return transcripts.fit([(r["transcript"], _states(r["truth"])) for r in sample])


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = as_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    chats = transcripts.parsed(rows.select("conv_id", "part", "transcript"), fit(rows), text="transcript")
    return chats.select("conv_id", "part", F.size("chat.turns").cast("long").alias("n_turns"), F.array_join(F.transform("chat.turns", lambda t: t["role"]), ",").alias("roles"), F.col("chat.rendered").alias("rendered"))
