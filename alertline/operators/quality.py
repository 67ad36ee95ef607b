"""Data checks. Each suite is one aggregation and yields (check, passed, observed) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertline.operators.curves import negative, positive
from alertline.operators.order import asc, find_ranges, running

MAX_BAD_TIMES = 0.001
BOUND_SLACK = 1e-12
MONOTONE_SLACK = 1e-10


class QualityError(AssertionError):
    """At least one check failed."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def bad_time_rate(df: DataFrame, time: str) -> Column:
    return F.coalesce(F.avg(F.col(time).isNull().cast("int")), F.lit(0.0))


def _report(df: DataFrame, checks: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """``checks`` are (name, observed aggregate, test on the column ``observed``)."""
    totals = df.agg(*[observed.cast("double").alias(f"_o{i}") for i, (_, observed, _t) in enumerate(checks)])
    rows = [F.struct(F.lit(n).alias("check"), F.col(f"_o{i}").alias("observed")) for i, (n, _, _t) in enumerate(checks)]
    passed = F.lit(None).cast("boolean")
    for name, _, test in checks:
        passed = F.when(F.col("check") == name, test).otherwise(passed)
    return totals.select(F.inline(F.array(*rows))).select("check", passed.alias("passed"), "observed")


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    absent = [c for c in names if c not in df.columns]
    if absent:
        raise QualityError(f"required columns are missing: {absent}")


def table_checks(df: DataFrame, label: str = "isFraud", time: str = "dt", seconds: str | None = "TransactionDT") -> DataFrame:
    """Checks on a cleaned table: binary label, valid times, numeric seconds; counts imputed times."""
    require_columns(df, [label, time, *([seconds] if seconds else [])])
    zero = F.col("observed") == 0
    bad_label = F.count_if(F.col(label).isNotNull() & ~F.col(label).isin(0, 1))
    checks = [
        ("label_is_binary", bad_label, zero),
        ("time_is_valid", bad_time_rate(df, time), F.col("observed") < MAX_BAD_TIMES),
    ]
    if seconds:
        numeric = isinstance(df.schema[seconds].dataType, T.NumericType)
        checks.append(("seconds_are_numeric", F.lit(int(numeric)), F.col("observed") == 1))
        checks.append(("times_from_missing_seconds", F.count_if(F.col(seconds).isNull()), F.lit(True)))
    return _report(df, checks)


def score_checks(df: DataFrame, id: str = "id", time: str = "time", y: str = "y", score: str = "score") -> DataFrame:
    """Checks before scores are frozen: key present and unique, times present, label and score finite, both classes."""
    require_columns(df, [id, time, y, score])
    zero = F.col("observed") == 0
    value = F.col(score).cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    single = _report(
        df,
        [
            ("rows", F.count(F.lit(1)), F.col("observed") > 0),
            ("id_not_null", F.count_if(F.col(id).isNull()), zero),
            ("time_not_null", F.count_if(F.col(time).isNull()), zero),
            ("label_not_null", F.count_if(F.col(y).isNull()), zero),
            ("score_finite", F.count_if(~finite), zero),
            ("positives", F.count_if(positive(y)), F.col("observed") > 0),
            ("negatives", F.count_if(negative(y)), F.col("observed") > 0),
        ],
    )
    copies = _report(duplicate_keys(df.filter(F.col(id).isNotNull()), [id]), [("id_unique", F.count(F.lit(1)), zero)])
    return single.unionByName(copies)


def probability_checks(df: DataFrame, p: str = "p_cal", score: str = "score") -> DataFrame:
    """Calibrated probabilities stay within [0, 1] and never fall while the score rises."""
    zero = F.col("observed") == 0
    value = F.col(p)
    inside = (value >= -BOUND_SLACK) & (value <= 1 + BOUND_SLACK)
    bounds = _report(df, [("probability_in_bounds", F.count_if(~F.coalesce(inside, F.lit(False))), zero)])
    drops = monotone_drops(df, p, score)
    return bounds.unionByName(_report(drops, [("probability_monotone", F.coalesce(F.sum("drops"), F.lit(0)), zero)]))


def split_checks(report: DataFrame) -> DataFrame:
    """Both sides of a time split hold rows, and the train side ends before the other begins."""
    train, val = F.col("side") == "train", F.col("side") == "val"
    last = F.max(F.when(train, F.col("time_max")))
    begin = F.min(F.when(val, F.col("time_min")))
    return _report(
        report,
        [
            ("train_rows", F.coalesce(F.sum(F.when(train, F.col("rows"))), F.lit(0)), F.col("observed") > 0),
            ("val_rows", F.coalesce(F.sum(F.when(val, F.col("rows"))), F.lit(0)), F.col("observed") > 0),
            ("no_overlap", F.coalesce((last < begin).cast("int"), F.lit(0)), F.col("observed") == 1),
        ],
    )


def enforce(report: DataFrame) -> None:
    """Raise if any check of a suite failed."""
    failed = [f"{r['check']} (observed {r['observed']})" for r in report.filter(~F.col("passed")).collect()]
    if failed:
        raise QualityError("failed checks: " + ", ".join(failed))


def monotone_drops(df: DataFrame, p: str, score: str = "score", slack: float = MONOTONE_SLACK) -> DataFrame:
    """How many steps between neighbouring scores (or inside one score) lower ``p`` by more than ``slack``."""
    rows = df.filter(F.col(score).isNotNull())
    blocks = rows.groupBy(score).agg(F.min(p).alias("_low"), F.max(p).alias("_high"))
    steps = running(
        blocks,
        [asc(score)],
        lag={"_before": "_high"},
        ranges=find_ranges(rows.select(score), [asc(score)]),
    )
    falls = (F.col("_low") - F.col("_before") < -slack) | (F.col("_low") - F.col("_high") < -slack)
    return steps.agg(F.count(F.lit(1)).alias("scores"), F.count_if(falls).alias("drops"))


def monotone_badges(points: DataFrame) -> DataFrame:
    """Whether the operating points of each mode move in the expected direction as the budget grows.

    FPR budgets: recall and alerts do not fall, the threshold does not rise, no FPR is above its budget.
    Top K%: precision and threshold do not rise, recall and FPR do not fall. One mode has a handful of rows.
    """
    along = Window.partitionBy("run_id", "calibrator", "window", "mode").orderBy("budget_value")

    def change(name: str) -> Column:
        return F.col(name) - F.lag(name).over(along)

    moved = points.select(
        "run_id",
        "calibrator",
        "window",
        "mode",
        "budget_value",
        "fpr",
        *[change(c).alias(f"d_{c}") for c in ("precision", "recall", "fpr", "alerts", "threshold_prob")],
        F.col("threshold_prob").isNull().alias("no_threshold"),
    )

    def up(name: str) -> Column:
        return F.coalesce(F.col(f"d_{name}") >= 0, F.lit(True))

    def down(name: str) -> Column:
        return F.coalesce(F.col(f"d_{name}") <= 0, F.lit(True))

    threshold = down("threshold_prob") & ~F.col("no_threshold")
    within = F.col("fpr") <= F.col("budget_value") / 100.0 + 1e-12
    fpr_mode = up("recall") & threshold & up("alerts") & within
    topk_mode = down("precision") & up("recall") & up("fpr") & threshold
    fine = F.when(F.col("mode") == "fpr", fpr_mode).otherwise(topk_mode)
    return moved.groupBy("run_id", "calibrator", "window", "mode").agg(F.min(fine).alias("monotone"))

