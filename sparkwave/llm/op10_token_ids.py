"""Query op10_token_ids: all documents to a token store and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import token_store


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = token_store.write_store(docs, "doc_id", "text", tokenizer_file())
    return token_store.read_store(spark, folder, digest=True).withColumnRenamed("key", "doc_id")
