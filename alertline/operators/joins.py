"""Joins of transactions with their identity rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined_view(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All left rows with their right row, if any. The right key is kept as ``<key>_1``.

    The join strategy is left to Spark, which knows the sizes and splits skewed keys at run time.
    """
    second = f"{key}_1"
    other = right.select(*[F.col(c).alias(second if c == key else c) for c in right.columns])
    return left.join(other, left[key] == other[second], "left")


def join_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many joined rows have a right side, out of how many left rows."""
    matched = left.select(key).join(right.select(key), key).agg(F.count(F.lit(1)).alias("with_identity"))
    return matched.withColumn("total", left.agg(F.count(F.lit(1)).alias("n")).scalar())
