"""Query op6_html_blocks: the main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_blocks


def op6_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = html_blocks.extracted(pages, markup="html")
    return found.select("page_id", "url", F.col("main.text").alias("text"), F.char_length("main.text").cast("long").alias("n_chars"))
