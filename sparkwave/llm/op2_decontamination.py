"""Query op2_decontamination: benchmark windows in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    seen = decontaminate.hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return seen.select(
        "doc_id", "hits.n_words", "hits.n_hit", "hits.n_items",
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("hits.n_hit"), F.col("hits.n_words")).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Columns doc_id, n_words, n_hit, items (sorted list) of the table or CTE named ``{docs}``.
HITS_SQL = f"""
d AS (SELECT doc_id, {_WORDS} AS w FROM {{docs}}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win))),
found AS (SELECT doc_id, i, k, item FROM grams JOIN win USING (k, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY doc_id),
hits AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(items, []) AS items
         FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN named ON d.doc_id = named.doc_id)
"""

SQL = f"""WITH {HITS_SQL.format(docs="documents")}
SELECT doc_id, n_words, n_hit, CAST(len(items) AS BIGINT) AS n_items, sha256(array_to_string(items, ',')) AS items_sha256,
       n_hit > 0 AND 20 * n_hit >= n_words AS contaminated
FROM hits"""
