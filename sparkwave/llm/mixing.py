"""Mixing sources to target weights: each source gives words up to its exact budget, in a random order that is always the same.

Sources share the table's words by weight; a target stops at ``max_epochs`` times its source's size, and the excess goes to
the other sources by weight until none is above. With sources in order of that limit over their weight, the ones that stop
come first, so prefix sums of limits and weights give the share of the rest without rounds.

A source gives its documents ``floor(target / size)`` times whole. For the rest its documents are range-sorted by a hash of
seed and id, prefix sums of their sizes are made in two levels (within slices of the order, and over the slices' totals), and
the order is cut where the budget, the target rounded to a whole number, ends: the document there gives its first words only.

Rows meet by source only as totals and slices, so a source may hold any share of the rows. Sources are counted, ranked and
summed by Spark, too.

Defined cases: a null or empty text has size 0 and gives 0 words; a null source is one, after all others; a null id hashes as
"null"; repeated rows each count and each take their place, in the order of their sizes; without any words all targets are
0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scan
from ..session import materialise

MAX_EPOCHS = 3
SEED = "mix"
#: The weights of sources in order, repeated.
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (source, size, weight) with the target of each source, as a double."""
    cap = sizes.withColumns({"cap": F.col("size") * max_epochs, "per_weight": F.col("size") * max_epochs / F.col("weight")})
    cap = scan.running_sums(cap, [], ["per_weight", "source"], {"caps_before": F.col("cap"), "weights_before": F.col("weight")})
    every = F.broadcast(sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight")))  # a single row
    share = (F.col("all_size") - F.col("caps_before")) / (F.col("all_weight") - F.col("weights_before"))
    marked = cap.crossJoin(every).withColumn("share", share)
    # the first source that its limit doesn't stop sets what all after it get by weight
    rest = marked.where(F.col("per_weight") >= F.col("share")).agg(F.min(F.struct("per_weight", "share")).alias("first"))
    level = F.coalesce(F.col("first.share"), F.lit(float("inf")))
    return marked.crossJoin(F.broadcast(rest)).select("source", "size", "weight", F.least(F.col("weight") * level, F.col("cap").cast("double")).alias("target"))


def ranked_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` (source, size) with the weight of each source's place by code point, null last."""
    counted = scan.running_sums(sizes.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], {"place": F.lit(1).cast("long")})
    return counted.select("source", "size", F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int")).cast("long").alias("weight"))


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """(key, source, size, source_size, target, taken, epochs, rest) of each row of ``docs``.

    ``epochs`` times the whole text and the first ``rest`` words once more are what the mix takes, ``taken`` words.
    """
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))))
    light = materialise(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), words_in(F.col(f"`{text}`")).alias("size"), draw.alias("draw")), "mix-sizes")
    sizes = materialise(light.groupBy("source").agg(F.sum("size").alias("size")), "mix-sources")
    wanted = targets(ranked_weights(sizes, weights), max_epochs)
    budget = F.least(F.round("target").cast("long"), F.col("size") * max_epochs)
    epochs = F.when(F.col("size") > 0, F.call_function("div", budget, F.col("size"))).otherwise(0).cast("long")
    plan = materialise(wanted.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target", epochs.alias("epochs"), (budget - epochs * F.col("size")).alias("budget")), "mix-targets")
    placed = scan.running_sums(light, ["source"], ["draw", "size", "key"], {"before": F.col("size")})
    rest = F.greatest(F.lit(0), F.least("size", F.col("budget") - F.col("before")))
    met = placed.join(plan, F.col("source").eqNullSafe(F.col("of")))
    return met.withColumn("rest", rest).select("key", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"), "epochs", "rest")


def mixed_texts(docs: DataFrame, mixed: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The training texts of a mix over unique keys: a row (key, epoch, text) for each time that a document is taken, in no
    order; of the last time only the first ``rest`` words. Whole words are kept with the white space between them."""
    taken = mixed.where("taken > 0").select("key", "epochs", "rest", "size", F.explode(F.sequence(F.lit(1), F.col("epochs") + (F.col("rest") > 0).cast("long"))).alias("epoch"))
    met = taken.join(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "key")
    pieces = F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("rest").cast("int"))
    partial = (F.col("epoch") > F.col("epochs")) & (F.col("rest") < F.col("size"))
    return met.select("key", "epoch", F.when(partial, F.array_join(pieces, "")).otherwise(F.col("text")).alias("text"))
