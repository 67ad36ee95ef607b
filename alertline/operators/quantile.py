"""Exact quantiles of many columns without collecting a column into one task."""

from __future__ import annotations

import math
import struct
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertline.operators.clean import column_chunks

SMALL_BRACKET = 1_000_000  # rows that may be counted value by value and ordered in one task
SKETCH_ACCURACY = 2_000
SKETCH_POINTS = 200  # quantiles that each part of a column is summed up by
SKETCH_PARTS = 64
SLACK_POINTS = 3  # how many of them a cut stands aside of the wanted position


@dataclass
class _Bracket:
    """A value range of one column known to hold the rows with positions ``lower`` and ``upper`` (from 0)."""

    column: str
    lower: int
    upper: int
    size: int
    low: float | None = None  # None: open
    high: float | None = None
    below: int = 0
    done: bool = False
    halve: bool = False  # the last cuts left most rows inside: next time cut the value range in the middle

    def inside(self, value: Column) -> Column:
        test = value.isNotNull()
        if self.low is not None:
            test &= value >= F.lit(self.low)
        if self.high is not None:
            test &= value <= F.lit(self.high)
        return test

    def narrow(self, cuts: Sequence[float], below: Sequence[int], upto: Sequence[int]) -> None:
        """Cut at values, given how many rows of the bracket are below, and not above, each of them."""
        size, start, end = self.size, self.below, self.below + self.size
        low, high = self.low, self.high
        for value, n_below, n_upto in zip(cuts, below, upto):
            if start + n_below <= self.lower and (low is None or value >= low):
                low, self.below = value, start + n_below
            if self.upper < start + n_upto and (high is None or value <= high):
                high, end = value, min(end, start + n_upto)
        self.low, self.high, self.size = low, high, end - self.below
        self.halve = self.size > size // 2
        self.done = low is not None and low == high


def _middle(low: float, high: float) -> float:
    """A value between two, in the middle of the numbers that their type has in between."""
    if isinstance(low, int) and isinstance(high, int):
        return low + (high - low) // 2
    a, b = (struct.unpack("<q", struct.pack("<d", float(v)))[0] for v in (low, high))
    a, b = (v if v >= 0 else -(2**63) - v for v in (a, b))  # ascending with the doubles
    mid = a + (b - a) // 2
    return struct.unpack("<d", struct.pack("<q", mid if mid >= 0 else -(2**63) - mid))[0]


def exact_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], small_bracket: int = SMALL_BRACKET
) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles of numeric columns; null for a column without values.

    A column of more than ``small_bracket`` rows is narrowed to a small value range by sketches first. Each
    narrowing is checked by exact counts, so the sketch decides how much work remains and not what the answer
    is; where it does not help, the value range is halved, until the bracket is small or holds one value. The
    values left in the range are then counted and ordered per column. Wide tables are handled some columns
    at a time, each group reading its own columns only.
    """
    result: dict[str, list[float | None]] = {}
    for chunk in column_chunks(list(wanted)):
        result.update(_chunk_quantiles(df, {c: wanted[c] for c in chunk}, small_bracket))
    return result


def _chunk_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], small_bracket: int
) -> dict[str, list[float | None]]:
    names = [c for c, qs in wanted.items() if qs]
    if not names:
        return {c: [] for c in wanted}
    data = df.select(*[_number(df, c) for c in names])
    counts = data.agg(*[F.count(c).alias(c) for c in names]).first()

    ranks: dict[tuple[str, float], tuple[int, int, float]] = {}
    brackets: list[_Bracket] = []
    for column in names:
        n = counts[column]
        if n == 0:
            continue
        for q in wanted[column]:
            position = q * (n - 1)
            lower = math.floor(position)
            ranks[(column, q)] = (lower, min(lower + 1, n - 1), position - lower)
        if n <= small_bracket:
            brackets.append(_Bracket(column, 0, n - 1, n, done=True))
        else:
            places = sorted({p for q in wanted[column] for p in ranks[(column, q)][:2]})
            brackets += [_Bracket(column, p, p, n) for p in places]  # one each, so that it ends at one value

    open_brackets = [b for b in brackets if not b.done]
    while open_brackets:
        _narrow(data, open_brackets)
        open_brackets = [b for b in open_brackets if not b.done and b.size > small_bracket]

    needed: dict[str, set[int]] = {}
    for (column, _), (lower, upper, _f) in ranks.items():
        needed.setdefault(column, set()).update((lower, upper))
    at: dict[tuple[str, int], float] = {}
    whole = {f.name for f in data.schema if f.dataType.typeName() == "long"}
    for kind in ("bigint", "double"):  # each column keeps its own type
        of_kind = [b for b in brackets if (b.column in whole) == (kind == "bigint")]
        if of_kind:
            at.update(_values_at(data, of_kind, needed, kind))

    def interpolate(column: str, q: float) -> float | None:
        if (column, q) not in ranks:
            return None
        lower, upper, fraction = ranks[(column, q)]
        a, b = at[(column, lower)], at[(column, upper)]
        return a if fraction == 0 else a + (b - a) * fraction

    return {c: [interpolate(c, q) for q in qs] for c, qs in wanted.items()}


def _number(df: DataFrame, column: str) -> Column:
    """Integers stay exact 64-bit integers, everything else is a double; NaN counts as missing."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("byte", "short", "integer", "long"):
        return F.col(column).cast("bigint").alias(column)
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value).alias(column)


def _narrow(data: DataFrame, brackets: list[_Bracket]) -> None:
    """One sketch pass and one counting pass over all brackets at once.

    Each of SKETCH_PARTS parts of the rows is summed up by its quantiles and their number; merged by these
    weights, they are the quantiles of the whole, however the values lie in the parts.
    """
    points = [(k + 0.5) / SKETCH_POINTS for k in range(SKETCH_POINTS)]

    def inside(b: _Bracket) -> Column:
        return F.when(b.inside(F.col(b.column)), F.col(b.column))

    summed = data.groupBy((F.spark_partition_id() % SKETCH_PARTS).alias("_part")).agg(
        *[F.percentile_approx(inside(b), points, SKETCH_ACCURACY).alias(f"_q{i}") for i, b in enumerate(brackets)],
        *[F.count(inside(b)).alias(f"_n{i}") for i, b in enumerate(brackets)],
        *[F.min(inside(b)).alias(f"_min{i}") for i, b in enumerate(brackets)],
        *[F.max(inside(b)).alias(f"_max{i}") for i, b in enumerate(brackets)],
    )
    parts = summed.collect()  # at most SKETCH_PARTS rows
    cuts = [_cuts(b, [tuple(p[f"{c}{i}"] for c in ("_q", "_n", "_min", "_max")) for p in parts]) for i, b in enumerate(brackets)]
    counters = []
    for i, (b, values) in enumerate(zip(brackets, cuts)):
        for k, cut in enumerate(values):
            counters.append(F.count_if(b.inside(F.col(b.column)) & (F.col(b.column) < F.lit(cut))).alias(f"below{i}_{k}"))
            counters.append(F.count_if(b.inside(F.col(b.column)) & (F.col(b.column) <= F.lit(cut))).alias(f"upto{i}_{k}"))
    counted = data.agg(*counters).first()
    for i, (b, values) in enumerate(zip(brackets, cuts)):
        below, upto = ([counted[f"{c}{i}_{k}"] for k in range(len(values))] for c in ("below", "upto"))
        b.narrow(values, below, upto)


def _cuts(b: _Bracket, parts: Sequence[tuple]) -> list[float]:
    """Ascending values around the wanted positions of a bracket, from (quantiles, rows, min, max) of its parts."""
    parts = [p for p in parts if p[1]]
    least, most = min(p[2] for p in parts), max(p[3] for p in parts)
    if b.halve:
        middle = _middle(least, most)
        return sorted({least, middle, most})
    weighed = sorted((value, n / len(values)) for values, n, _, _ in parts for value in values)
    step = b.size / SKETCH_POINTS
    wanted = [b.lower - b.below - SLACK_POINTS * step, b.upper - b.below + SLACK_POINTS * step]
    reached, found = 0.0, [least, most]
    for value, weight in weighed:
        if reached <= wanted[0]:
            found[0] = value
        if reached <= wanted[1]:
            found[1] = value
        reached += weight
    if wanted[0] <= 0:
        found[0] = least
    if wanted[1] >= b.size:
        found[1] = most
    return sorted({least, most, *found})


def _values_at(
    data: DataFrame, brackets: list[_Bracket], needed: Mapping[str, set[int]], kind: str
) -> dict[tuple[str, int], float]:
    """The values at the wanted positions. Equal values are counted before they are shuffled."""
    entries = [
        F.when(
            b.inside(F.col(b.column)),
            F.struct(F.lit(i).alias("bracket"), F.col(b.column).cast(kind).alias("value")),
        )
        for i, b in enumerate(brackets)
    ]
    counts = (
        data.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy("e.bracket", "e.value")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    along = Window.partitionBy("bracket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = counts.withColumn("end", F.sum("times").over(along))
    tests = []
    for i, b in enumerate(brackets):
        start = F.lit(b.below)
        wanted = [p for p in sorted(needed[b.column]) if b.lower <= p <= b.upper]
        hit = reduce(
            lambda x, y: x | y,
            [(start + F.col("end") - F.col("times") <= p) & (p < start + F.col("end")) for p in wanted],
        )
        tests.append((F.col("bracket") == i) & hit)
    found: dict[tuple[str, int], float] = {}
    for row in cumulative.filter(reduce(lambda x, y: x | y, tests)).collect():  # at most the wanted positions
        b = brackets[row["bracket"]]
        for p in needed[b.column]:
            if b.below + row["end"] - row["times"] <= p < b.below + row["end"]:
                found[(b.column, p)] = row["value"]
    return found
