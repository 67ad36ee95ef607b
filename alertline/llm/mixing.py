"""Mixing sources to target weights by hash thresholds, in column expressions and aggregations only.

Every document has a 60-bit hash. A source's mix is whole passes over it and, for what is left of its
target, the documents whose hash is below a threshold. To find the threshold nothing is sorted: sizes are
summed by source and the first bits of the hash, the bucket in which the sum reaches the budget is cut by
the next bits, and so on. A larger target only ever adds documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertline.llm.text import n_words
from alertline.session import stored

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_PASSES = 2
LEVEL_BITS = 12
LEVELS = 5
BROADCAST_SOURCES = 200_000


def document_hash() -> Column:
    """60 bits of the MD5 of a document's id; of its text, where it has no id."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), "text"), F.lit(""))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share_percent: int = SHARE_PERCENT, weights: tuple = WEIGHTS) -> DataFrame:
    """Add ``target`` to a table of ``source`` and ``source_size``.

    Sources in code point order (null last) have the weights in turn. ``share_percent`` of all sizes is
    shared by weight; a target stops at MAX_PASSES times its source's size, and the excess is shared by
    weight among the others until none is above. The sources that stop are those with the least size for
    their weight, so one running sum over the sources in that order finds them. There is a row for each
    source, which one task holds.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight.cast("long")).withColumn("_place", place)
    everything = Window.partitionBy(F.lit(0))
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), "_place")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    budget = share_percent * F.sum("source_size").over(everything)  # in hundredths
    left = budget - 100 * MAX_PASSES * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    weighed = weighed.withColumn("_left", left).withColumn("_weight_left", weight_left)
    most = 100 * MAX_PASSES * F.col("source_size")
    stops = F.col("weight").cast("double") * F.col("_left") >= most.cast("double") * F.col("_weight_left")
    weighed = weighed.withColumn("_stops", stops)
    none_stops = F.when(~F.col("_stops"), F.struct("_left", "_weight_left"))
    # the first source in that order that does not stop, and all after it, share what is left
    free = F.max(none_stops).over(everything)
    share = F.col("weight").cast("double") * free["_left"] / (100.0 * free["_weight_left"])
    target = F.when(F.col("_stops"), (MAX_PASSES * F.col("source_size")).cast("double")).otherwise(share)
    return weighed.withColumn("target", target).drop("weight", "_place", "_left", "_weight_left", "_stops")


def mix(docs: DataFrame, share_percent: int = SHARE_PERCENT) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``times`` (how often the mix takes the document).

    Reads ``doc_id``, ``text`` and ``source``. The size is the number of words; a null or empty text has
    none, whatever its ``times``. A source's taken words differ from its target by half a document at
    most. Documents with equal hashes (repeated ids) are taken together or not at all. A null source is a
    source of its own; a source without words has the target 0. An empty table gives an empty result.
    Other columns stay, but those of the names added are replaced.
    """
    docs = docs.withColumn("size", n_words(F.col("text"))).withColumn("_hash", document_hash())
    slim = stored(docs.select("source", "size", "_hash"), "mixing")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    budgets = source_targets(sizes, share_percent)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = budgets.withColumn("_passes", passes.cast("int"))
    budgets = budgets.withColumn("_rest", F.col("target") - F.col("_passes") * F.col("source_size"))
    budgets = stored(budgets, "budgets")
    few = budgets.count() <= BROADCAST_SOURCES
    cuts = _thresholds(slim, budgets.select("source", "_rest"), few)
    budgets = stored(_beside(budgets, cuts, "left", few), "thresholds")
    out = _beside(docs.drop("source_size", "target", "times"), budgets, "left", few)
    once_more = F.coalesce(F.col("_hash") <= F.col("_cut"), F.lit(False)).cast("int")
    return out.withColumn("times", F.col("_passes") + once_more).drop("_hash", "_passes", "_rest", "_cut")


def _beside(left: DataFrame, right: DataFrame, how: str, broadcast: bool) -> DataFrame:
    """Join on source, where null equals null; a table of few sources is sent to all tasks."""
    right = right.withColumnRenamed("source", "_source")
    right = F.broadcast(right) if broadcast else right
    return left.join(right, left["source"].eqNullSafe(right["_source"]), how).drop("_source")


def _thresholds(slim: DataFrame, budgets: DataFrame, few: bool) -> DataFrame:
    """For each source, the largest hash that is taken (``_cut``), null if none is.

    At each level, ``_before`` is what lies below the boundary bucket and ``_low`` its first bits. A bucket
    is passed if its sum stays within the budget. At the last level a bucket is one hash value; the one
    that goes beyond the budget is taken if that comes nearer.
    """
    state = budgets.withColumn("_low", F.lit(0).cast("long")).withColumn("_before", F.lit(0).cast("long"))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = _beside(slim, state, "inner", few)
        if level:
            inside = inside.filter(F.shiftright("_hash", shift + LEVEL_BITS) == F.col("_low"))
        bucket = inside.withColumn("_low", F.shiftright("_hash", shift))
        cells = bucket.groupBy("source", "_rest", "_before", "_low").agg(F.sum("size").alias("_size"))
        running = Window.partitionBy("source").orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_size").over(running), F.lit(0)))
        cells = cells.withColumn("_end", F.col("_start") + F.col("_size"))
        # the first bucket that goes beyond the budget; sources that never do are done
        beyond = cells.filter("_end > _rest").groupBy("source", "_rest").agg(
            F.min(F.struct("_low", "_start", "_end")).alias("b")
        )
        state = beyond.select("source", "_rest", F.col("b._low").alias("_low"), F.col("b._start").alias("_before"), "b._end")
        if level < LEVELS - 1:
            state = stored(state.drop("_end"), "boundary")
    nearer = F.col("_end") - F.col("_rest") < F.col("_rest") - F.col("_before")
    return state.select("source", F.when(nearer, F.col("_low")).otherwise(F.col("_low") - 1).alias("_cut"))


def taken(mixed: DataFrame) -> Column:
    """Words the mix takes of a document, repeats counted."""
    return F.col("size") * F.col("times")


def repeat_taken(mixed: DataFrame) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, without the columns of ``mix``."""
    often = mixed.filter("times > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return often.drop("size", "source_size", "target", "times", "_n")
