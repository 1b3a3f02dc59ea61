"""Query op7_jaccard_join: near-duplicate components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import jaccard_join


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


_ALL = "abcdefghijklmnopqrstuvwxyz"

#: CTEs up to ``component`` (doc_id, component_id) of the table or CTE named ``{docs}``.
COMPONENT_SQL = rf"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_ALL.upper()}', '{_ALL}'), '[^\x20\x09-\x0D]+') AS w FROM {{docs}}),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
sizes AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN g ON w.doc_id = g.doc_id GROUP BY w.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
component AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
"""

SQL = f"""WITH RECURSIVE {COMPONENT_SQL.format(docs="documents")}
SELECT sizes.doc_id, CAST(n AS BIGINT) AS n_shingles, component_id FROM sizes JOIN component USING (doc_id)"""
