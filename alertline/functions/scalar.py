"""Scalar column expressions. All of them are built-in functions, evaluated in the JVM."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANCHOR = "2017-01-01"


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as double, and 0 where the denominator is not positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double")).otherwise(F.lit(0.0))


def epoch_micros(column: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (session zone UTC)."""
    return F.unix_micros(column.cast("timestamp"))


def micros_literal(micros: int) -> Column:
    """A zone-less timestamp constant; it folds to a literal, so comparisons with it push down."""
    return F.timestamp_micros(F.lit(micros).cast("bigint")).cast("timestamp_ntz")


def to_micros(moment: str | datetime) -> int:
    """Microseconds since 1970 of a zone-less moment given as ISO text or datetime."""
    parsed = datetime.fromisoformat(moment) if isinstance(moment, str) else moment
    delta = parsed.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def sql_literal(value, dtype: T.DataType) -> str:
    """SQL text of a constant of a column's type; it folds to a literal. Timestamps are given as epoch micros."""
    kind = dtype.simpleString()
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        return f"CAST(timestamp_micros({value}L) AS {kind})"
    if isinstance(value, str):
        text = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"CAST('{text}' AS {kind})"
    return f"CAST('{value!r}' AS {kind})"


def anchored_time(seconds: Column, anchor: str = ANCHOR) -> Column:
    """Anchor date plus a number of seconds; a missing number becomes the anchor itself."""
    micros = F.round(F.coalesce(seconds.cast("double"), F.lit(0.0)) * 1e6).cast("bigint")
    return F.timestamp_micros(micros + F.lit(to_micros(anchor))).cast("timestamp_ntz")


def day_since(moment: Column, anchor: str = ANCHOR) -> Column:
    """Whole days from the anchor date to the date of ``moment``."""
    return F.datediff(F.to_date(moment), F.to_date(F.lit(anchor)))


def lenient_timestamp(column: Column) -> Column:
    """Parse a moment; text that is no moment becomes null."""
    return F.try_to_timestamp(column.cast("string")).cast("timestamp_ntz")


def strict_timestamp(column: Column) -> Column:
    """Parse a moment; text that is no moment fails the job (ANSI cast)."""
    return column.cast("timestamp_ntz")


def lenient_number(column: Column) -> Column:
    """A double; text that is no number, and NaN, become null."""
    number = column.try_cast("double")
    return F.when(~F.isnan(number), number)


def lenient_label(column: Column) -> Column:
    """An integer label; whatever is no number becomes 0, fractions are cut off."""
    return F.coalesce(lenient_number(column).try_cast("int"), F.lit(0))
