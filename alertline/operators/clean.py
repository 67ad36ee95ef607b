"""Cleaning: sentinels, sparse and duplicate columns, contracted projections, filters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertline.functions.scalar import ANCHOR, anchored_time, day_since, micros_literal, to_micros

# What stands for "missing" in the raw tables.
STRING_SENTINEL = "missing"
NUMERIC_SENTINELS = (-1, -999)

SPARSE_LIMIT = 0.90
CHUNK = 40  # columns of one wide aggregation
NOT_FEATURES = (
    "TransactionID",
    "TransactionID_1",
    "isFraud",
    "dt",
    "TransactionDT",
    "hour",
    "day",
    "weekday",
)


def _is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def _replace(df: DataFrame, tests: Callable[[T.StructField], Column | None]) -> DataFrame:
    """Null wherever the test of a column holds, all columns in one projection."""
    columns = []
    for field in df.schema:
        column, missing = F.col(f"`{field.name}`"), tests(field)
        columns.append(column if missing is None else F.when(~missing, column).alias(field.name))
    return df.select(*columns)


def _is_nan(field: T.StructField) -> Column | None:
    return F.isnan(F.col(f"`{field.name}`")) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else None


def _is_text_sentinel(field: T.StructField) -> Column | None:
    return F.col(f"`{field.name}`") == STRING_SENTINEL if isinstance(field.dataType, T.StringType) else None


def _is_number_sentinel(field: T.StructField) -> Column | None:
    return F.col(f"`{field.name}`").isin(*NUMERIC_SENTINELS) if _is_number(field.dataType) else None


def without_nan(df: DataFrame, column: str) -> DataFrame:
    """NaN in one column becomes null; columns of other types than float and double stay as they are."""
    if df.schema[column].dataType.typeName() not in ("float", "double"):
        return df
    value = F.col(f"`{column}`")
    return df.withColumn(column, F.when(~F.isnan(value), value))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value in the sources; in Spark it would count, average and sort as a value."""
    return _replace(df, _is_nan)


def drop_string_sentinel(df: DataFrame) -> DataFrame:
    """Null instead of the sentinel text (exact match) in every string column."""
    return _replace(df, _is_text_sentinel)


def drop_numeric_sentinels(df: DataFrame) -> DataFrame:
    """Null instead of the sentinel numbers in every numeric column, key and label included."""
    return _replace(df, _is_number_sentinel)


def clean(df: DataFrame) -> DataFrame:
    """All encodings of "missing" become null."""

    def any_of(field: T.StructField) -> Column | None:
        tests = [t for t in (_is_nan(field), _is_text_sentinel(field), _is_number_sentinel(field)) if t is not None]
        return reduce(lambda x, y: x | y, tests) if tests else None

    return _replace(df, any_of)


def column_chunks(columns: Sequence[str], size: int = CHUNK) -> list[list[str]]:
    """Groups of columns small enough for one generated aggregation; each scans its own columns only."""
    return [list(columns[i : i + size]) for i in range(0, len(columns), size)]


def missing_rates(df: DataFrame) -> dict[str, float]:
    """Share of nulls per column. Each column is read once."""
    rates: dict[str, float] = {}
    for chunk in column_chunks(df.columns):
        counts = df.agg(
            F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(chunk)]
        ).first()
        if counts["_rows"] == 0:
            return {}
        rates.update({c: (counts["_rows"] - counts[f"_c{i}"]) / counts["_rows"] for i, c in enumerate(chunk)})
    return rates


def sparse_columns(df: DataFrame, limit: float = SPARSE_LIMIT) -> list[str]:
    """Columns with a missing rate strictly above ``limit``."""
    return [c for c, rate in missing_rates(df).items() if rate > limit]


def drop_sparse(df: DataFrame, limit: float = SPARSE_LIMIT) -> DataFrame:
    return df.drop(*sparse_columns(df, limit))


def add_time_features(df: DataFrame, seconds: str = "TransactionDT", anchor: str = ANCHOR) -> DataFrame:
    """``dt`` (anchor date plus seconds), ``hour``, ``day`` (since the anchor), ``weekday`` (Monday is 0)."""
    moment = anchored_time(F.col(seconds), anchor)
    return df.select(
        "*",
        moment.alias("dt"),
        F.hour(moment).alias("hour"),
        day_since(moment, anchor).alias("day"),
        F.weekday(moment).alias("weekday"),
    )


def drop_features(df: DataFrame, names: Sequence[str] = NOT_FEATURES) -> tuple[DataFrame, list[str], list[str]]:
    """Drop the named columns; also returns which of them were found and which were not, sorted."""
    found = sorted(c for c in names if c in df.columns)
    return df.drop(*found), found, sorted(c for c in names if c not in df.columns)


def column_types(df: DataFrame) -> tuple[list[str], list[str]]:
    """Sorted numeric (or boolean) columns, and the sorted rest."""
    numeric = sorted(f.name for f in df.schema if _is_number(f.dataType) or isinstance(f.dataType, T.BooleanType))
    return numeric, sorted(set(df.columns) - set(numeric))


def select_contract(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The contracted columns in the contracted order (after ``keep``); fails if any is absent."""
    absent = [c for c in (*keep, *features) if c not in df.columns]
    if absent:
        raise ValueError(f"contracted columns are missing: {absent}")
    return df.select(*keep, *features)


@dataclass(frozen=True)
class FeatureReport:
    dropped: list[str]
    not_found: list[str]
    numeric: list[str]
    categorical: list[str]

    def row(self) -> dict:
        return {
            "dropped_features": self.dropped,
            "drop_candidates_not_found": self.not_found,
            "n_features_total": len(self.numeric) + len(self.categorical),
            "n_numeric": len(self.numeric),
            "n_categorical": len(self.categorical),
            "numeric": self.numeric,
            "categorical": self.categorical,
        }


def feature_report(df: DataFrame, not_features: Sequence[str] = NOT_FEATURES) -> FeatureReport:
    features, found, absent = drop_features(df, not_features)
    return FeatureReport(found, absent, *column_types(features))


def present(df: DataFrame, *names: str) -> tuple[DataFrame, Column]:
    """Rows in which the named columns are not null, and the test that was used (to count the rest)."""
    test = F.lit(True)
    for name in names:
        test &= F.col(name).isNotNull()
    return df.filter(test), test


def time_between(df: DataFrame, time: str, after: str | None = None, upto: str | None = None) -> DataFrame:
    """Rows with ``after < time <= upto``; the bounds are constants, so the scan can skip files."""
    if after is not None:
        df = df.filter(F.col(time) > micros_literal(to_micros(after)))
    if upto is not None:
        df = df.filter(F.col(time) <= micros_literal(to_micros(upto)))
    return df


def to_score_schema(df: DataFrame, id: str, time: str, y: str, score: str = "score") -> DataFrame:
    """The frozen score table: id, time, y, score."""
    return df.select(F.col(id).alias("id"), F.col(time).alias("time"), F.col(y).alias("y"), F.col(score).alias("score"))


def predicted(score: str, threshold: float) -> Column:
    """1 where the score reaches the threshold (inclusive)."""
    return (F.col(score) >= F.lit(threshold)).cast("int")
