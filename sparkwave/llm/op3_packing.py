"""Query op3_packing: all documents packed into sequences of 1024 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import packing
from .op10_token_ids import tokenizer_file


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(docs, "doc_id", "text", tokenizer_file(), with_ids=False)
