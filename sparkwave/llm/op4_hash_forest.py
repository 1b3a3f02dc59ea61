"""Query op4_hash_forest: the 20 nearest embeddings of every twentieth one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hash_forest


def op4_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hash_forest.search(rows, F.col("vec_id") % 20 == 0, key="vec_id", vector="embedding", k=20)
