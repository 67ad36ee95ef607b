"""Column functions: casts, time features, guarded arithmetic, literals."""

from alertline.functions.scalar import (
    anchored_time,
    day_since,
    epoch_micros,
    lenient_label,
    lenient_number,
    lenient_timestamp,
    micros_literal,
    ratio,
    sql_literal,
    strict_timestamp,
)

__all__ = [
    "anchored_time",
    "day_since",
    "epoch_micros",
    "lenient_label",
    "lenient_number",
    "lenient_timestamp",
    "micros_literal",
    "ratio",
    "sql_literal",
    "strict_timestamp",
]
