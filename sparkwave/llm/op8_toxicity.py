"""Query op8_toxicity: toxicity scores of all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels aren't learnt from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.fit(docs.where(~held_out()), labels.where(~held_out()))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = toxicity.scored(docs, fit(spark, docs, sf_dir), evidence=0)
    score = F.col("toxicity.score")
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score"), toxicity.is_toxic(score).cast("int").alias("predicted"))
