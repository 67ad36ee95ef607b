"""Global order without a single task: ranks, running totals, selection by position.

A window with an ORDER BY and no PARTITION BY sends every row to one task. Here the
order is cut into ranges first, so that each range is one window partition, and the
totals of the earlier ranges are added from a small broadcast table.

The ranges come from approximate quantiles of the first sort key. Where one value of
that key is so frequent that it fills whole ranges, only that value is cut again along
the next key (and so on), so a score shared by a third of all rows still spreads over
many tasks. The cut points are constants of the plan: they steer how work is spread and
never what the result is, and a lost executor recomputes into the same ranges.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertline.functions.scalar import epoch_micros, sql_literal
from alertline.session import stored

ROWS_PER_RANGE = 4_000_000  # more rows than that in a range of the first key ask for more ranges
BROADCAST_CELLS = 1_000_000  # a table of more ranges is joined by a shuffle
EXACT_DOUBLES = 2.0**53  # integers up to here are doubles of their own
HOT_WEIGHT = 4.0  # a value filling this many ranges is cut again along the next key
SKETCH_PER_RANGE = 10  # sketch resolution: a tenth of a range
MAX_SKETCHES = 128


@dataclass(frozen=True)
class Key:
    """One sort key: a numeric or timestamp column, nulls always last."""

    name: str
    descending: bool = False

    def sort(self) -> Column:
        column = F.col(self.name)
        return column.desc_nulls_last() if self.descending else column.asc_nulls_last()

    def as_double(self, dtype: T.DataType) -> Column:
        """A double that ascends along the order. Zero is added to turn -0.0 into 0.0."""
        column = F.col(self.name)
        if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            column = epoch_micros(column)
        column = column.cast("double")
        return F.lit(0.0) - column if self.descending else column + F.lit(0.0)


def desc(name: str) -> Key:
    return Key(name, True)


def asc(name: str) -> Key:
    return Key(name, False)


def alert_order(score: str = "score", time: str = "time", id: str = "id") -> list[Key]:
    """The deterministic alert order: highest score first, then earliest, then smallest id.

    It is total if ids are unique, which ``quality.score_checks`` verifies.
    """
    return [desc(score), asc(time), asc(id)]


def sort_columns(keys: Sequence[Key]) -> list[Column]:
    return [key.sort() for key in keys]


def ordered(df: DataFrame, keys: Sequence[Key]) -> DataFrame:
    """Rows in the total order, range-partitioned by Spark."""
    return df.orderBy(*sort_columns(keys))


def _one_of(name: str, values: Sequence[float | None]) -> Column:
    """``name`` is one of ``values``, of which null may be one."""
    member = F.coalesce(F.col(name).isin([v for v in values if v is not None]), F.lit(False))
    return member | F.col(name).isNull() if None in values else member


@dataclass(frozen=True)
class Ranges:
    """Cut points per key, and the frequent values that continue into the next key."""

    keys: tuple[Key, ...]
    splits: tuple[tuple[float, ...], ...]
    hot: tuple[tuple[float | None, ...], ...] = field(default=())
    # of the last key: how many neighbouring cells are one, and for which values of the key before
    steps: tuple[tuple[int, tuple[float | None, ...]], ...] = field(default=())

    @property
    def columns(self) -> list[str]:
        return [f"_range{i}" for i in range(len(self.splits))]

    @property
    def most_cells(self) -> int:
        """A bound for the number of ranges: cells of the first key, and those inside its frequent values."""
        cells = len(self.splits[0])
        for level in range(1, len(self.splits)):
            steps = {v: step for step, values in self.steps for v in values} if level == len(self.splits) - 1 else {}
            inside = sum(len(self.splits[level]) // steps.get(v, 1) + 1 for v in self.hot[level - 1])
            cells += inside * max(1, len(self.hot[level - 2])) if level > 1 else inside
        return cells

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the range columns; ordering by them agrees with ordering by the keys."""
        count = len(self.splits)
        doubles = [f"_key{i}" for i in range(count)]
        cells = [f"_cell{i}" for i in range(count)]
        keyed = df.select(
            "*", *[k.as_double(df.schema[k.name].dataType).alias(d) for k, d in zip(self.keys, doubles)]
        )
        bucketizer = Bucketizer(
            splitsArray=[list(s) for s in self.splits], inputCols=doubles, outputCols=cells, handleInvalid="keep"
        )
        columns = []
        for level, (cell, name) in enumerate(zip(cells, self.columns)):
            number = F.coalesce(F.col(cell), F.lit(len(self.splits[level]))).cast("int")  # nulls last
            if level:
                if level == count - 1:
                    for step, values in self.steps:
                        number = F.when(
                            _one_of(doubles[level - 1], values), F.floor(number / step).cast("int")
                        ).otherwise(number)
                inside = reduce(lambda a, b: a & b, [_one_of(doubles[i], self.hot[i]) for i in range(level)])
                number = F.when(inside, number).otherwise(F.lit(-1))
            columns.append(number.alias(name))
        return bucketizer.transform(keyed).select(*df.columns, *columns)


def range_count(spark: SparkSession) -> int:
    """Number of ranges to begin with: a few per shuffle partition."""
    return max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def _merge_quantiles(found: Sequence[tuple], count: int) -> list[float]:
    """Quantiles of the union of parts, each given by (its quantiles, rows, non-null rows)."""
    parts = [(q, filled) for q, _, filled in found if filled]
    if not parts:
        return []
    values = np.concatenate([q for q, _ in parts])
    weights = np.concatenate([np.full(len(q), filled / len(q)) for q, filled in parts])
    order = np.argsort(values, kind="stable")
    reached = np.cumsum(weights[order])
    wanted = (np.arange(1, count + 1) / (count + 1)) * reached[-1]
    at = np.minimum(np.searchsorted(reached, wanted), len(values) - 1)
    return [float(v) for v in values[order][at]]


def find_ranges(df: DataFrame, keys: Sequence[Key], count: int | None = None) -> Ranges:
    """Choose cut points that spread the rows of ``df`` evenly along ``keys``.

    One sketch pass per key (two for the first, if its ranges turn out to hold more than ROWS_PER_RANGE rows);
    the passes after the first read only the frequent values and happen only if there are any. Sketches
    meet in up to ``MAX_SKETCHES`` groups, so that no task merges the sketches of all input splits; the
    driver merges their quantiles.
    """
    spark = df.sparkSession
    given, count = count, count or range_count(spark)
    names = [f"_key{i}" for i in range(len(keys))]
    data = df.select(*[k.as_double(df.schema[k.name].dataType).alias(n) for k, n in zip(keys, names)])

    exact = [not isinstance(df.schema[k.name].dataType, T.DecimalType) for k in keys]
    groups: dict[tuple, float] = {(): float(count)}
    splits: list[tuple[float, ...]] = []
    hot: list[tuple[float | None, ...]] = []
    steps: tuple[tuple[int, tuple[float | None, ...]], ...] = ()
    for level, name in enumerate(names):
        cells = count if level == 0 else max(2, min(count, math.ceil(max(groups.values()))))
        found = _sketch(data, names[:level], name, cells, groups)
        if level == 0 and given is None:
            rows = sum(row["_n"] for row in found)
            if rows > count * ROWS_PER_RANGE:  # once more, with ranges that a task can hold
                count = cells = math.ceil(rows / ROWS_PER_RANGE)
                groups = {(): float(count)}
                found = _sketch(data, names[:level], name, cells, groups)
        parts: dict[tuple, list] = {}
        for row in found:
            group = tuple(row[:level])
            if group in groups:
                parts.setdefault(group, []).append((row["_q"], row["_n"], row["_filled"]))
        cuts: set[float] = set()
        frequent: dict[tuple, float] = {}
        for group, found in parts.items():
            quantiles = _merge_quantiles(found, cells - 1)
            weight = groups[group] * sum(f for _, _, f in found) / sum(n for _, n, _ in found)
            if quantiles:
                cuts.update(quantiles[:: max(1, int(len(quantiles) / max(weight, 1.0)))])
            for value, times in Counter(quantiles).items():
                share = weight * times / len(quantiles)
                # beyond 2 ** 53 a double may stand for several numbers, which must stay together
                if share >= HOT_WEIGHT and abs(value) < EXACT_DOUBLES and exact[level]:
                    frequent[(*group, value)] = share
                    cuts.update((value, math.nextafter(value, math.inf)))
            if groups[group] - weight >= HOT_WEIGHT:
                frequent[(*group, None)] = groups[group] - weight
        inner = sorted(c for c in cuts if math.isfinite(c)) or [0.0]
        splits.append((-math.inf, *inner, math.inf))
        if not frequent:
            steps = _steps(groups, len(inner) + 1) if level else ()
            break
        hot.append(tuple(sorted({group[-1] for group in frequent}, key=lambda v: (v is None, v or 0.0))))
        groups = frequent
    return Ranges(tuple(keys), tuple(splits), tuple(hot), steps)


def _sketch(data: DataFrame, prefix: Sequence[str], name: str, cells: int, groups: Mapping[tuple, float]) -> list:
    """Quantiles of a key inside each of the given groups, from some parts of the rows of each.

    Returns MAX_SKETCHES rows, or one for each group if these are more.
    """
    shares = ", ".join(f"{i / cells!r}D" for i in range(1, cells))
    rows = data
    if prefix:
        wanted = data.sparkSession.createDataFrame(
            [tuple(g) for g in groups], ", ".join(f"_w{i} double" for i in range(len(prefix)))
        )
        same = [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(prefix)]
        rows = data.join(F.broadcast(wanted), reduce(lambda a, b: a & b, same), "left_semi")
    fan = max(1, MAX_SKETCHES // len(groups))
    sketches = rows.groupBy(*prefix, (F.spark_partition_id() % fan).alias("_part")).agg(
        F.expr(f"percentile_approx({name}, array({shares}), {SKETCH_PER_RANGE * cells})").alias("_q"),
        F.count(F.lit(1)).alias("_n"),
        F.count(name).alias("_filled"),
    )
    return sketches.collect()


def _steps(groups: Mapping[tuple, float], cells: int) -> tuple[tuple[int, tuple[float | None, ...]], ...]:
    """How many neighbouring cells count as one inside each frequent value, so that it has about twice its share.

    The cuts of the last key are those of all frequent values together; without this, each value would be cut
    by the cuts of all others. Steps are powers of two, so that there are few.
    """
    weights: dict[float | None, float] = {}
    for group, weight in groups.items():
        weights[group[-1]] = max(weight, weights.get(group[-1], 0.0))
    by_step: dict[int, list[float | None]] = {}
    for value, weight in weights.items():
        step = 1 << max(0, math.floor(math.log2(max(1.0, cells / (2 * weight)))))
        if step > 1:
            by_step.setdefault(step, []).append(value)
    return tuple((step, tuple(values)) for step, values in sorted(by_step.items()))


def running(
    df: DataFrame,
    keys: Sequence[Key],
    sums: Mapping[str, Column] | None = None,
    *,
    by: Sequence[str] = (),
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    ranges: Ranges | None = None,
    source: tuple[DataFrame, Mapping[str, Column]] | None = None,
) -> DataFrame:
    """Global row number and running totals along ``keys``.

    Adds ``rank`` (from 1), ``cum_<name>`` and ``all_<name>`` (the grand total) for each
    entry of ``sums``, ``n_rows``, and for ``lag``/``lead`` ``{new: column}`` the value on
    the neighbouring row. ``lag``/``lead`` need the first key to be unique. ``by`` keeps one order
    per group, of which there may be a few hundred (columns, iterations). If ``df`` is itself an aggregate, ``source`` may name the rows it came from and
    their contribution to each sum, so that the range totals need not wait for that aggregate
    (``rank`` and ``n_rows`` are then counted in source rows and of no use).

    The table of range totals has one row per non-empty range, a few times the number of ranges; it is
    broadcast if its cells are few enough. The join is a left join only to spare the rows a null filter.
    """
    sums, lag, lead = dict(sums or {}), dict(lag or {}), dict(lead or {})
    ranges = ranges or find_ranges(df, keys)
    first = keys[0].as_double(df.schema[keys[0].name].dataType)

    def with_values(table: DataFrame, values: Mapping[str, Column]) -> DataFrame:
        return ranges.assign(table.select("*", *[v.cast("bigint").alias(f"_v_{n}") for n, v in values.items()]))

    data = with_values(df, sums)
    cell = [*by, *ranges.columns]
    totals = (with_values(*source) if source else data).groupBy(*cell).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums],
        *[F.max_by(c, first).alias(f"_last_{n}") for n, c in lag.items()],
        *[F.min_by(c, first).alias(f"_first_{n}") for n, c in lead.items()],
    )
    along = Window.partitionBy(*by).orderBy(*ranges.columns)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)

    def before(column: str) -> Column:
        return F.coalesce(F.sum(column).over(earlier), F.lit(0))

    offsets = totals.select(
        *cell,
        before("_n").alias("_o_rank"),
        F.sum("_n").over(whole).alias("n_rows"),
        *[before(f"_s_{n}").alias(f"_o_{n}") for n in sums],
        *[F.coalesce(F.sum(f"_s_{n}").over(whole), F.lit(0)).alias(f"all_{n}") for n in sums],
        *[F.lag(f"_last_{n}").over(along).alias(f"_o_{n}") for n in lag],
        *[F.lead(f"_first_{n}").over(along).alias(f"_o_{n}") for n in lead],
    )
    inside = Window.partitionBy(*cell).orderBy(*sort_columns(keys))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = data.select(
        *df.columns,
        *ranges.columns,
        F.row_number().over(inside).alias("_rank"),
        *[F.sum(f"_v_{n}").over(so_far).alias(f"_c_{n}") for n in sums],
        *[F.lag(c).over(inside).alias(f"_c_{n}") for n, c in lag.items()],
        *[F.lead(c).over(inside).alias(f"_c_{n}") for n, c in lead.items()],
        *[F.count(F.lit(1)).over(inside.rowsBetween(1, 1)).alias(f"_more_{n}") for n in lead],
    )
    few = ranges.most_cells <= BROADCAST_CELLS and not by
    joined = local.join(F.broadcast(offsets) if few else offsets, cell, "left")
    return joined.select(
        *[joined[c] for c in df.columns],
        (F.col("_rank") + F.col("_o_rank")).cast("bigint").alias("rank"),
        "n_rows",
        *[(F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.col(f"_o_{n}")).cast("bigint").alias(f"cum_{n}") for n in sums],
        *[F.col(f"all_{n}").cast("bigint").alias(f"all_{n}") for n in sums],
        *[F.when(F.col("_rank") > 1, F.col(f"_c_{n}")).otherwise(F.col(f"_o_{n}")).alias(n) for n in lag],
        *[F.when(F.col(f"_more_{n}") > 0, F.col(f"_c_{n}")).otherwise(F.col(f"_o_{n}")).alias(n) for n in lead],
    )


def rank_rows(df: DataFrame, keys: Sequence[Key]) -> DataFrame:
    """Every row with its global position (``rank`` from 1)."""
    return running(df, keys).drop("n_rows")


class Ladder:
    """Row counts per range of an order, to find rows by position without sorting the table.

    ``counters`` are extra predicates that are counted along (``row`` counts every row), so
    "the 100th row" and "the 7th negative" are both positions. The counts are one small
    aggregation; it is collected, as its size is bounded by the number of ranges.

    With a single key, rows with equal keys need no order among them: they are counted per
    value before anything is shuffled.
    """

    def __init__(self, df: DataFrame, keys: Sequence[Key], counters: Mapping[str, Column] | None = None):
        self.df, self.keys = df, list(keys)
        self.counters = {"row": F.lit(True), **(counters or {})}
        names = [k.name for k in self.keys]
        slim = df.select(*names, *[c.cast("boolean").alias(f"_is_{n}") for n, c in self.counters.items()])
        self.ranges = find_ranges(slim, self.keys)
        self._rows = self.ranges.assign(slim)
        totals = self._rows.groupBy(*self.ranges.columns).agg(
            *[F.count_if(f"_is_{n}").alias(n) for n in self.counters]
        )
        table = totals.toArrow().to_pandas().sort_values(self.ranges.columns, ignore_index=True)
        self._cells = table[self.ranges.columns]
        self._counts = {n: table[n].to_numpy(dtype=np.int64) for n in self.counters}
        self._found: dict[tuple[str, int], tuple] = {}

    def total(self, counter: str = "row") -> int:
        return int(self._counts[counter].sum())

    def find(self, **positions: Sequence[int]) -> dict[tuple[str, int], tuple]:
        """Key values of the rows at positions (from 1), as ``{(counter, position): values}``.

        Only the ranges that hold a wanted position are shuffled and sorted. Timestamps come
        back as epoch micros. Positions outside the table are absent.
        """
        open_positions = {n: sorted({p for p in ps if (n, p) not in self._found}) for n, ps in positions.items()}
        hits: dict[int, dict[str, list[int]]] = {}
        before = {n: np.cumsum(self._counts[n]) - self._counts[n] for n in open_positions}
        for name, wanted in open_positions.items():
            for p in wanted:
                if 1 <= p <= self.total(name):
                    cell = int(np.searchsorted(before[name] + self._counts[name], p))
                    hits.setdefault(cell, {}).setdefault(name, []).append(p)
        if hits:
            self._search(hits, before)
        return {(n, p): self._found[(n, p)] for n, ps in positions.items() for p in ps if (n, p) in self._found}

    def _search(self, hits: Mapping[int, Mapping[str, Sequence[int]]], before: Mapping[str, np.ndarray]) -> None:
        names = [k.name for k in self.keys]
        used = sorted({n for by_name in hits.values() for n in by_name})
        is_hit, is_wanted = [], []
        for cell, by_name in hits.items():
            same = " AND ".join(f"{c} = {self._cells[c][cell]}" for c in self.ranges.columns)
            is_hit.append(f"WHEN {same} THEN {cell}")
            for name, positions in by_name.items():
                for p in positions:  # the step that reaches the position
                    local = p - before[name][cell]
                    is_wanted.append(f"(_hit = {cell} AND `_at_{name}` >= {local} AND `_at_{name}` - `_step_{name}` < {local})")
        inside = Window.partitionBy("_hit").orderBy(*sort_columns(self.keys))
        so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = self._rows.withColumn("_hit", F.expr(f"CASE {' '.join(is_hit)} END")).filter("_hit IS NOT NULL")
        if len(self.keys) == 1:
            steps = rows.groupBy("_hit", *names).agg(*[F.count_if(f"_is_{n}").alias(f"_step_{n}") for n in used])
        else:
            steps = rows.select("_hit", *names, *[F.col(f"_is_{n}").cast("bigint").alias(f"_step_{n}") for n in used])
        stairs = steps.select("*", *[F.sum(f"_step_{n}").over(so_far).alias(f"_at_{n}") for n in used])
        plain = [
            epoch_micros(F.col(n)).alias(n)
            if isinstance(self.df.schema[n].dataType, (T.TimestampNTZType, T.TimestampType))
            else F.col(n)
            for n in names
        ]
        found = stairs.filter(" OR ".join(is_wanted)).select(
            "_hit", *[f"_step_{n}" for n in used], *[f"_at_{n}" for n in used], *plain
        )
        for row in found.collect():  # at most one row per wanted position
            values = tuple(row)[-len(names) :]
            for name, positions in hits[row["_hit"]].items():
                end = row[f"_at_{name}"] + int(before[name][row["_hit"]])
                for p in positions:
                    if end - row[f"_step_{name}"] < p <= end:
                        self._found[(name, p)] = values


def rows_at(df: DataFrame, keys: Sequence[Key], positions: Sequence[int]) -> dict[int, tuple]:
    """The key values of the rows at the given positions (from 1) of the total order."""
    return {p: values for (_, p), values in Ladder(df, keys).find(row=positions).items()}


def not_after(df: DataFrame, keys: Sequence[Key], row: Sequence, *, strict: bool = False) -> Column:
    """Predicate: a row stands at or before ``row`` (strictly before, if ``strict``) in the order.

    It is never null, and its parts are plain comparisons with constants, which a scan can use.
    """
    text = "false" if strict else "true"
    for key, value in reversed(list(zip(keys, row))):
        name = f"`{key.name}`"
        if value is None:
            text = f"({name} IS NOT NULL OR {text})"
            continue
        constant = sql_literal(value, df.schema[key.name].dataType)
        ahead = f"{name} IS NOT NULL AND {name} {'>' if key.descending else '<'} {constant}"
        text = f"(({ahead}) OR ({name} <=> {constant} AND {text}))"
    return F.expr(text)


def flag_first(ladder: Ladder, count: int, name: str) -> DataFrame:
    """The ladder's rows with ``name``: whether a row is among the first ``count``, exactly that many.

    Usually that is a filter against the row at ``count``. Only if the rows equal to it reach beyond
    ``count``, these alone are numbered, by a hash of the row, and as many as are needed are taken.
    """
    df = ladder.df
    row = ladder.find(row=[count]).get(("row", count))
    if row is None:
        return df.withColumn(name, F.lit(False))
    before, upto = not_after(df, ladder.keys, row, strict=True), not_after(df, ladder.keys, row)
    n_before, n_upto = df.agg(F.count_if(before), F.count_if(upto)).first()
    if n_upto == count:
        return df.withColumn(name, upto)
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    equal = df.filter(upto & ~before).withColumn("_hash", hashed).withColumn("_row", F.monotonically_increasing_id())
    equal = stored(equal, "equal")  # a task that runs again must not number its rows anew
    numbered = rank_rows(equal, [asc("_hash"), asc("_row")])
    taken = numbered.select(*df.columns, (F.col("rank") <= count - n_before).alias(name))
    return df.filter(~upto | before).withColumn(name, before).unionByName(taken)
