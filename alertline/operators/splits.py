"""Splits along time: at an exact quantile, or at a row position."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertline.functions.scalar import epoch_micros, micros_literal
from alertline.operators.order import Ladder, asc, flag_first
from alertline.operators.quantile import exact_quantiles

TRAIN_SHARE = 0.80


def time_cut(df: DataFrame, time: str = "dt", share: float = TRAIN_SHARE) -> int | None:
    """Exact interpolated quantile of a time column in epoch micros, rounded down; null times are skipped."""
    micros = df.select(epoch_micros(F.col(time)).alias("_us"))
    value = exact_quantiles(micros, {"_us": (share,)})["_us"][0]
    return None if value is None else math.floor(value)


def time_split(df: DataFrame, cut: int, time: str = "dt") -> tuple[DataFrame, DataFrame]:
    """Rows up to and including the cut, and rows after it; rows without a time are in neither."""
    moment = micros_literal(cut)
    return df.filter(F.col(time) <= moment), df.filter(F.col(time) > moment)


def split_report(df: DataFrame, cut: int, time: str = "dt", label: str = "isFraud") -> DataFrame:
    """Rows, first and last time, positives, negatives and prevalence of both sides, in one pass."""
    side = F.when(F.col(time) <= micros_literal(cut), F.lit("train")).otherwise(F.lit("val"))
    hits = F.count_if(F.col(label) == 1)
    rows = F.count(F.lit(1))
    return (
        df.filter(F.col(time).isNotNull())
        .groupBy(side.alias("side"))
        .agg(
            rows.alias("rows"),
            F.min(time).alias("time_min"),
            F.max(time).alias("time_max"),
            hits.alias("pos"),
            (rows - hits).alias("neg"),
            (hits / rows).alias("prevalence"),
        )
    )


@dataclass(frozen=True)
class Split:
    """Both sides of a positional split, earliest rows first."""

    head: DataFrame
    tail: DataFrame
    boundary: tuple | None


def positional_split(df: DataFrame, share: float = TRAIN_SHARE, time: str = "time", id: str = "id") -> Split:
    """The first ``share`` of the rows by (time, id), rounded down, and the rest.

    The order itself is never built: the row at the cut is found, and the sides are filters against it. Only
    rows that are equal to it may have to be told apart by their content.
    """
    ladder = Ladder(df, [asc(time), asc(id)])
    count = int(share * ladder.total())
    flagged = flag_first(ladder, count, "_head")
    head, tail = flagged.filter("_head").drop("_head"), flagged.filter("NOT _head").drop("_head")
    return Split(head, tail, ladder.find(row=[count]).get(("row", count)))
