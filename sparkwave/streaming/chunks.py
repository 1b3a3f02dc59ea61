"""Statistics of fixed-size chunks over a recording that is read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources import datasource

STATS = "chunk long, channel int, low long, high long, n long"


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """(chunk, channel, low, high, n) of blocks cut at chunk borders, without exploding them; partial sums before the shuffle."""
    per = chunks.select("chunk", "channel", F.array_min("values").alias("low"), F.array_max("values").alias("high"), F.size("values").cast("long").alias("n"))
    return per.groupBy("chunk", "channel").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def stream_chunk_stats(spark: SparkSession, uri: str, size: int, *, out: str | None = None, log: str | None = None, **options: str) -> DataFrame:
    """The statistics of a recording's finished chunks, read as a stream until no more of it is there.

    Batches begin and end at chunk borders, so no chunk has rows in two of them and there is no state: each batch adds its
    chunks to ``out``, in a folder named by its number, which a batch that is run again replaces. With the same ``out`` and
    ``log`` a later call goes on where the one before it ended.
    """
    datasource.register(spark)
    out, log = out or scratch_dir(spark, "chunks"), log or scratch_dir(spark, "chunks-log")
    stream = spark.readStream.format(datasource.NAME).options(rows="chunks", chunk_samples=size, **options).load(uri)

    def add(batch: DataFrame, number: int) -> None:
        chunk_stats(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
    return spark.read.schema(f"{STATS}, batch int").parquet(out).drop("batch")
