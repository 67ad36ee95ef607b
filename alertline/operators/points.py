"""Operating points: what happens if the top K% are alerted, or if an FPR budget is spent.

None of these sorts the table. The row where a selection ends is found by position (a
``Ladder`` sorts one range of the order only) and becomes a constant; the counts are then one
aggregation with a predicate against that constant.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertline.functions.scalar import ratio
from alertline.operators.clean import without_nan
from alertline.operators.curves import TIE_WIDTH, negative, positive, tie_block_staircase
from alertline.operators.order import Key, Ladder, alert_order, asc, desc, flag_first, not_after

K_PERCENT = (0.5, 1.0, 2.0, 5.0)
FPR_PERCENT = (0.1, 0.5, 1.0, 2.0)
POINT_KEY = ("run_id", "calibrator", "window")
POINT_COLUMNS = (
    *POINT_KEY,
    "mode",
    "budget_type",
    "budget_value",
    "threshold_prob",
    "precision",
    "recall",
    "fpr",
    "alerts",
    "alerts_per_day",
)
_TABLE_SCHEMA = (
    "mode string, K_or_FPR double, threshold double, precision double, recall double, fpr double, "
    "alerts bigint, alerts_per_day double"
)


def ceil_count(percent: float, rows: int) -> int:
    """Rows in the top ``percent`` %: rounded up, all rows at most."""
    return min(rows, math.ceil((percent / 100.0) * rows))


def floor_count(share: float, rows: int) -> int:
    """Rows in the top ``share`` (a fraction): rounded down, at least one."""
    return min(rows, max(1, int(rows * share)))


def allowed_negatives(budget: float, negatives: int) -> int:
    """The most false positives whose rate, as a double, is within ``budget`` (a fraction)."""
    if negatives == 0:
        return 0
    most = min(negatives, int(budget * negatives) + 1)
    while most > 0 and most / negatives > budget:
        most -= 1
    return most


def alert_ladder(df: DataFrame, score: str = "score", y: str = "y", whole_blocks: bool = False) -> Ladder:
    """Rows, positives, negatives and scored rows along the alert order.

    Where only whole score blocks matter, the order among equal scores is left out.
    """
    counters = {"positive": positive(y), "negative": negative(y), "scored": F.col(score).isNotNull()}
    return Ladder(df, [desc(score)] if whole_blocks else label_order(score, y), counters)


def label_order(score: str, y: str) -> list[Key]:
    """The alert order, and among rows that are equal in it the lower label first.

    Rows that are still equal count the same for every metric, so a budget may end between any two.
    """
    return [*alert_order(score), asc(y)]


def flag_topk(df: DataFrame, percent: float, score: str = "score") -> DataFrame:
    """Mark the rows of the top ``percent`` % of the alert order (exactly that many) as ``selected``.

    Of rows that are equal in the order, as many as are needed are marked, by a hash of the row. NaN
    scores are missing ones, which come last.
    """
    df = without_nan(df, score)
    ladder = Ladder(df, alert_order(score))
    return flag_first(ladder, ceil_count(percent, ladder.total()), "selected")


def _rows_before(ladder: Ladder, count: int) -> tuple[Column, tuple | None]:
    """Predicate of the rows strictly before the row at ``count``, and that row's keys."""
    row = ladder.find(row=[count]).get(("row", count))
    return (F.lit(False), None) if row is None else (not_after(ladder.df, ladder.keys, row, strict=True), row)


@dataclass(frozen=True)
class _Selection:
    """The rows one budget alerts. ``empty_fpr`` is reported if it alerts none.

    If ``rows`` or ``negatives`` says how many there must be, what ``chosen`` lacks is taken from the rows
    that are equal to ``tie`` (score, time, id, label).
    """

    mode: str
    budget: float
    chosen: Column
    threshold: float | None = None
    lowest_chosen: bool = False  # the threshold is the lowest chosen score
    empty_fpr: float = 0.0
    rows: int | None = None
    negatives: int | None = None
    tie: tuple | None = None

    def taken(self, alerts: Column, negatives: Column) -> Column:
        if self.tie is None:
            return F.lit(0)
        missing = F.lit(self.rows) - alerts if self.rows is not None else F.lit(self.negatives) - negatives
        return F.greatest(missing, F.lit(0))


def _measure(df: DataFrame, selections: Sequence[_Selection], ladder: Ladder, score: str, y: str) -> DataFrame:
    """Metrics of all selections from one aggregation; no row is moved for it."""
    table = df.select(
        F.col(score).cast("double").alias("_score"),
        F.to_date("time").alias("_day"),
        positive(y).alias("_pos"),
        negative(y).alias("_neg"),
        *[s.chosen.alias(f"_in{i}") for i, s in enumerate(selections)],
    )
    aggregates = [F.count_distinct("_day").alias("_days")]
    for i, s in enumerate(selections):
        aggregates += [
            F.expr(f"count_if(_in{i})").alias(f"_alerts{i}"),
            F.expr(f"count_if(_in{i} AND _pos)").alias(f"_tp{i}"),
            F.expr(f"count_if(_in{i} AND _neg)").alias(f"_fp{i}"),
        ]
        if s.lowest_chosen:  # a selection that reaches into the unscored rows has no threshold
            lowest = f"CASE WHEN count_if(_in{i} AND _score IS NULL) = 0 THEN min(CASE WHEN _in{i} THEN _score END) END"
            aggregates.append(F.expr(lowest).alias(f"_low{i}"))
    rows = F.array(*[_measured(s, i) for i, s in enumerate(selections)])
    alerts, tp, fp = F.col("alerts"), F.col("_tp"), F.col("_fp")
    fpr = F.when(alerts == 0, F.col("_empty_fpr")).otherwise(ratio(fp, F.lit(ladder.total("negative"))))
    return (
        table.agg(*aggregates)
        .select("_days", F.inline(rows))
        .select(
            "mode",
            "K_or_FPR",
            "threshold",
            ratio(tp, tp + fp).alias("precision"),
            ratio(tp, F.lit(ladder.total("positive"))).alias("recall"),
            fpr.alias("fpr"),
            "alerts",
            ratio(alerts, F.col("_days")).alias("alerts_per_day"),
        )
    )


def _measured(s: _Selection, i: int) -> Column:
    """The counts of one selection, with the tied rows it takes."""
    taken = s.taken(F.col(f"_alerts{i}"), F.col(f"_fp{i}"))
    label = None if s.tie is None else s.tie[-1]
    threshold = F.lit(s.threshold).cast("double")
    if s.lowest_chosen:
        tied = F.lit(None if s.tie is None else s.tie[0]).cast("double")
        threshold = F.when(taken > 0, tied).otherwise(F.col(f"_low{i}"))
    return F.struct(
        F.lit(s.mode).alias("mode"),
        F.lit(float(s.budget)).alias("K_or_FPR"),
        threshold.alias("threshold"),
        F.lit(float(s.empty_fpr)).alias("_empty_fpr"),
        (F.col(f"_alerts{i}") + taken).cast("bigint").alias("alerts"),
        (F.col(f"_tp{i}") + taken * int(label == 1)).cast("bigint").alias("_tp"),
        (F.col(f"_fp{i}") + taken * int(label == 0)).cast("bigint").alias("_fp"),
    )


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], _TABLE_SCHEMA)


def _topk_selections(ladder: Ladder, percents: Sequence[float]) -> list[_Selection]:
    counts = [ceil_count(p, ladder.total()) for p in percents]
    ladder.find(row=counts)
    selections = []
    for p, c in zip(percents, counts):
        chosen, end = _rows_before(ladder, c)
        selections.append(_Selection("topk", p, chosen, None if end is None else end[0], rows=c, tie=end))
    return selections


def topk_table(
    df: DataFrame, percents: Sequence[float] = K_PERCENT, score: str = "score", y: str = "y"
) -> DataFrame:
    """Selection metrics of the top K% rows (rounded up), one row per K; the threshold is the last selected score."""
    df = without_nan(df, score)
    ladder = alert_ladder(df, score, y)
    if ladder.total() == 0:
        return _empty(df)
    return _measure(df, _topk_selections(ladder, percents), ladder, score, y)


def precision_at_k(
    df: DataFrame, shares: Sequence[float] = (0.005, 0.01, 0.02, 0.05), score: str = "score", y: str = "y"
) -> DataFrame:
    """Precision of the top share of rows, rounded down with a minimum of one row."""
    df = without_nan(df, score)
    ladder = Ladder(df, label_order(score, y))
    if ladder.total() == 0:
        return df.sparkSession.createDataFrame([], "share double, k bigint, precision double")
    counts = [floor_count(s, ladder.total()) for s in shares]
    ladder.find(row=counts)
    hits = [_hits(ladder, c, y).alias(f"h{i}") for i, c in enumerate(counts)]
    rows = [
        F.struct(
            F.lit(float(s)).alias("share"),
            F.lit(c).cast("bigint").alias("k"),
            ratio(F.col(f"h{i}"), F.lit(c)).alias("precision"),
        )
        for i, (s, c) in enumerate(zip(shares, counts))
    ]
    return df.agg(*hits).select(F.inline(F.array(*rows)))


def _hits(ladder: Ladder, count: int, y: str) -> Column:
    """Positives among the first ``count`` rows, as an aggregate."""
    before, end = _rows_before(ladder, count)
    tied = 0 if end is None else int(end[-1] == 1)
    return F.count_if(before & positive(y)) + tied * (F.lit(count) - F.count_if(before))


def topk_precisions(
    df: DataFrame, scores: Sequence[str], percents: Sequence[float] = K_PERCENT, y: str = "y"
) -> DataFrame:
    """Precision in the top K% (rounded up) under several score columns, one row per column and K.

    The rows where the selections end are found per column; the hits of all of them are one aggregation.
    """
    hits, rows = [], []
    for s in scores:
        df = without_nan(df, s)
    for s in scores:
        ladder = Ladder(df, label_order(s, y))
        counts = [ceil_count(p, ladder.total()) for p in percents]
        ladder.find(row=counts)
        for p, c in zip(percents, counts):
            name = f"h{len(hits)}"
            hits.append(_hits(ladder, c, y).alias(name))
            rows.append(
                F.struct(
                    F.lit(s).alias("score_name"),
                    F.lit(float(p)).alias("K"),
                    F.lit(c).cast("bigint").alias("k_rows"),
                    (F.col(name) / F.lit(c) if c else F.lit(None)).cast("double").alias("precision"),
                )
            )
    return df.agg(*hits).select(F.inline(F.array(*rows)))


def _excess(ladder: Ladder, budgets: Sequence[float]) -> list[int | None]:
    """Per budget (a fraction) the first negative it cannot pay for, by position; None if it pays for all."""
    negatives = ladder.total("negative")
    allowed = [allowed_negatives(b, negatives) for b in budgets]
    return [m + 1 if m < negatives else None for m in allowed]


def _excess_rows(ladder: Ladder, budgets: Sequence[float]) -> list[tuple | None]:
    positions = _excess(ladder, budgets)
    found = ladder.find(negative=[p for p in positions if p])
    return [found[("negative", p)] if p else None for p in positions]


def recall_at_fpr(
    df: DataFrame, targets: Sequence[float] = (0.001, 0.005, 0.01, 0.02), score: str = "score", y: str = "y"
) -> DataFrame:
    """Highest recall on the ROC curve (whole score blocks) with FPR within each target."""
    scored = without_nan(df, score).filter(F.col(score).isNotNull())
    ladder = alert_ladder(scored, score, y, whole_blocks=True)
    hits, rows = [], []
    for i, (t, end) in enumerate(zip(targets, _excess_rows(ladder, targets))):
        chosen = F.lit(True) if end is None else F.col(score) > F.lit(end[0])
        hits.append(F.count_if(chosen & positive(y)).alias(f"h{i}"))
        recall = ratio(F.col(f"h{i}"), F.lit(ladder.total("positive")))
        rows.append(F.struct(F.lit(float(t)).alias("target_fpr"), recall.alias("recall")))
    return scored.agg(*hits).select(F.inline(F.array(*rows)))


def fpr_rows(
    df: DataFrame, percents: Sequence[float] = FPR_PERCENT, score: str = "score", y: str = "y"
) -> DataFrame:
    """Per FPR budget the last row of the alert order within it; equal scores may be cut apart."""
    df = without_nan(df, score)
    ladder = alert_ladder(df, score, y)
    if ladder.total() == 0:
        return _empty(df)
    one_negative = ratio_of(1, ladder.total("negative"))
    selections = []
    negatives = ladder.total("negative")
    for p, end in zip(percents, _excess_rows(ladder, [p / 100.0 for p in percents])):
        chosen = F.lit(True) if end is None else not_after(df, ladder.keys, end, strict=True)
        allowed = allowed_negatives(p / 100.0, negatives)
        selections.append(
            _Selection(
                "fpr", p, chosen, lowest_chosen=True, empty_fpr=one_negative, negatives=allowed, tie=end
            )
        )
    return _measure(df, selections, ladder, score, y)


def ratio_of(count: int, total: int) -> float:
    return count / total if total else 0.0


def _block_selections(
    df: DataFrame, ladder: Ladder, percents: Sequence[float], score: str, y: str, width: float
) -> list[_Selection]:
    """Per budget the rows down to the lowest affordable threshold.

    The excess negative has some score; the next higher score is the threshold, unless the two
    are so close that they count as one. Only then the blocks of nearly equal scores are built.
    """
    negatives = ladder.total("negative")
    if ladder.total("scored") == 0:
        first = alert_ladder(df, score, y).find(row=[1], negative=[1])
        starts_negative = first.get(("negative", 1)) == first.get(("row", 1))
        return [
            _Selection("fpr", p, F.lit(False), empty_fpr=ratio_of(int(starts_negative), negatives)) for p in percents
        ]
    value = F.col(score).cast("double")
    excess = _excess_rows(ladder, [p / 100.0 for p in percents])
    floors = [None if e is None or e[0] is None else float(e[0]) for e in excess]
    around = []
    for i, f in enumerate(floors):
        if f is None:  # every scored row is affordable
            around += [F.min(value).alias(f"up{i}"), F.lit(None).alias(f"down{i}"), F.lit(0).alias(f"at{i}")]
        else:
            around += [
                F.min(F.when(value > F.lit(f), value)).alias(f"up{i}"),
                F.max(F.when(value < F.lit(f), value)).alias(f"down{i}"),
                F.count_if((value == F.lit(f)) & negative(y)).alias(f"at{i}"),
            ]
    seen = df.agg(*around).first()
    thresholds, top_fp, close = [], 0, False
    for i, f in enumerate(floors):
        up, down = seen[f"up{i}"], seen[f"down{i}"]
        thresholds.append(up)
        if up is not None:
            close |= f is not None and up - f <= width
        else:  # the excess negative has the highest score of all
            top_fp = seen[f"at{i}"]
            close |= down is not None and f - down <= width
    if close:
        stairs = tie_block_staircase(df, score, y, width)
        ends = stairs.agg(
            F.max(F.struct(value.alias("threshold"), "cum_fp")).alias("top"),
            *[
                F.min(value if f is None else F.when(value > F.lit(f), value)).alias(f"_t{i}")
                for i, f in enumerate(floors)
            ],
        ).first()
        thresholds, top_fp = list(ends)[1:], ends["top"]["cum_fp"]
    return [
        _Selection(
            "fpr",
            p,
            F.lit(False) if t is None else F.coalesce(value >= F.lit(t), F.lit(False)),
            t,
            empty_fpr=ratio_of(top_fp, negatives),
        )
        for p, t in zip(percents, thresholds)
    ]


def fpr_blocks(
    df: DataFrame,
    percents: Sequence[float] = FPR_PERCENT,
    score: str = "score",
    y: str = "y",
    width: float = TIE_WIDTH,
) -> DataFrame:
    """Per FPR budget the lowest threshold within it, where a threshold never cuts (nearly) equal scores apart."""
    df = without_nan(df, score)
    ladder = alert_ladder(df, score, y, whole_blocks=True)
    if ladder.total() == 0:
        return _empty(df)
    return _measure(df, _block_selections(df, ladder, percents, score, y, width), ladder, score, y)


def operating_points(
    df: DataFrame,
    run_id: str,
    calibrator: str,
    window: str = "full",
    score: str = "p_cal",
    y: str = "y",
    k_percents: Sequence[float] = K_PERCENT,
    fpr_percents: Sequence[float] = FPR_PERCENT,
) -> DataFrame:
    """Top-K% and FPR-budget rows of one scored window in one table with fixed columns.

    Both kinds share the counts along the order and the final aggregation.
    """
    df = without_nan(df, score)
    ladder = alert_ladder(df, score, y)
    if ladder.total() == 0:
        both = _empty(df)
    else:
        excess = _excess(ladder, [p / 100.0 for p in fpr_percents])
        ladder.find(
            row=[ceil_count(p, ladder.total()) for p in k_percents], negative=[p for p in excess if p]
        )  # one search for both kinds
        selections = _topk_selections(ladder, k_percents) + _block_selections(
            df, ladder, fpr_percents, score, y, TIE_WIDTH
        )
        both = _measure(df, selections, ladder, score, y)
    kind = F.when(F.col("mode") == "topk", F.lit("K_percent")).otherwise(F.lit("FPR_percent"))
    return both.select(
        F.lit(run_id).alias("run_id"),
        F.lit(calibrator).alias("calibrator"),
        F.lit(window).alias("window"),
        "mode",
        kind.alias("budget_type"),
        F.col("K_or_FPR").alias("budget_value"),
        F.col("threshold").alias("threshold_prob"),
        "precision",
        "recall",
        "fpr",
        "alerts",
        "alerts_per_day",
    ).orderBy("window", "mode", "budget_type", "budget_value")
