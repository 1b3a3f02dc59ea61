"""Query op13_mixing: all documents mixed to weights 1, 2, 3 of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixing.mix(docs).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "source", "epochs", "rest")


SQL = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
c AS (SELECT *, size * 3 / weight AS per_weight, coalesce(sum(size * 3) OVER w, 0) AS caps_before, coalesce(sum(weight) OVER w, 0) AS weights_before FROM s
  WINDOW w AS (ORDER BY size * 3 / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, ((SELECT sum(size) FROM s) - caps_before) / ((SELECT sum(weight) FROM s) - weights_before) AS share FROM c),
l AS (SELECT arg_min(share, per_weight) AS level FROM h WHERE per_weight >= share),
t AS (SELECT source, size AS source_size, least(weight * level, CAST(size * 3 AS DOUBLE)) AS target FROM s, l),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t),
p AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE CAST(epochs * size + rest AS BIGINT) END AS taken, source, epochs, rest
FROM (SELECT doc_id, size, source_size, target, p.source, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END AS epochs,
  CAST(greatest(0, least(size, CASE WHEN source_size = 0 THEN 0 ELSE budget % source_size END - before)) AS BIGINT) AS rest
  FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source)"""
