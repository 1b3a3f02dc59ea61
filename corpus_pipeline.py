"""A corpus pipeline over ``documents``: toxic documents go, one document of each near-duplicate group stays, documents
with benchmark text go, and what is left is packed into training sequences.

Each stage reads all that its predecessor kept, written as Parquet. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkwave.llm import decontaminate, jaccard_join, op8_toxicity, packing, toxicity
from sparkwave.llm.common import give_back
from sparkwave.llm.op10_token_ids import tokenizer_file
from sparkwave.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, from the nearest labelled examples, stays below the threshold."""
    kept = toxicity.clean_documents(docs, op8_toxicity.fit(spark, docs, sf_dir))
    give_back()  # the driver needs neither the model nor what it was fitted on any more
    return kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by 5-word shingles at similarity 0.75, that with the smallest id."""
    return jaccard_join.deduplicate(docs, "doc_id", "text")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than a twentieth of their words in benchmark windows."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of 1024."""
    return packing.pack(docs, "doc_id", "text", tokenizer_file(), with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: The stages use a tokenizer and a fitted model, which SQL can't express; the tests plant what each stage has to drop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; the others are written and read again in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
