"""Connected components of an edge table by alternating large and small stars.

Defined cases: edges with a null end and loops are left out; repeated edges count once; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, materialise_observed

#: Rounds after which the job fails. A path of 2^k nodes takes about k of them, so no table comes near.
MAX_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """(doc, component) for every node of ``edges`` (a, b), written; a component is named by its smallest node."""
    return materialise(_members(_stars(edges)), "components")


def _members(links: DataFrame) -> DataFrame:
    return links.select(F.col("u").alias("doc"), F.col("v").alias("component")).union(links.select(F.col("v").alias("doc"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v), written: each node of ``edges`` but a component's smallest, with that one.

    Each round sends a node's neighbours to the smallest node around it: a minimum per node, summed map-side, and a
    join, which Spark splits where a node is skewed. Rounds end when the links are stars, which a further round wouldn't
    change; they are few, as stars halve paths. A round is one written table and a look at it: each query leaves plans,
    tasks and metrics in the driver's memory.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    for _ in range(MAX_ROUNDS):
        links, seen = materialise_observed(links, "links", F.count("*").alias("n"))
        if not seen.get("n") or _are_stars(links):
            return links
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        links = small.where("u <> v").distinct()
    raise RuntimeError(f"components aren't complete after {MAX_ROUNDS} rounds")


def _are_stars(links: DataFrame) -> bool:
    """Whether each node of different links (u, v) with v < u has one link as u, or only links as v."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high"))
    ends = ends.union(links.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return ends.where("low > 1 or low = 1 and high = 1").count() == 0


def merged(within: DataFrame, edges: DataFrame) -> DataFrame:
    """The components ``within`` (doc, component) after further edges (a, b): those of the components are joined."""
    a, b = (within.select(F.col("doc").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab")
    between = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = _members(_stars(between))
    new = joined.withColumnRenamed("doc", "old").withColumnRenamed("component", "new")
    kept = within.join(new, F.col("component") == F.col("old"), "left").select("doc", F.coalesce("new", "component").alias("component"))
    return materialise(kept.union(joined.join(within, "doc", "left_anti")), "components")
