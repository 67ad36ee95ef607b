"""From frozen scores to decisions: tables, calibration, operating points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertline.functions.scalar import lenient_label, lenient_number
from alertline.operators.calibration import (
    ISOTONIC,
    CalibrationMetrics,
    Calibrator,
    calibration_metrics,
    choose_calibrator,
    isotonic_from_blocks,
    platt_from_blocks,
    require_both_classes,
)
from alertline.operators.curves import curve_summary, score_blocks
from alertline.operators.points import fpr_rows, operating_points, topk_table
from alertline.operators.quality import enforce, monotone_badges, probability_checks, require_columns
from alertline.operators.splits import positional_split
from alertline.session import stored
from alertline.sources.sinks import read_points, upsert_points, write_csv, write_parquet
from alertline.sources.tables import CALIBRATED_SCORES

SCORE_COLUMNS = ("id", "time", "y", "score")


def typed_scores(df: DataFrame) -> DataFrame:
    """The score columns with a numeric score (or null) and an integer label."""
    require_columns(df, SCORE_COLUMNS)
    return df.withColumns({"score": lenient_number(F.col("score")), "y": lenient_label(F.col("y"))})


def baseline_tables(scores: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Top-K% and FPR-budget tables of the uncalibrated scores, also written as CSV."""
    typed = typed_scores(scores)
    tables = topk_table(typed), fpr_rows(typed)
    for table, name in zip(tables, ("top_k_table", "recall_at_fpr")):
        write_csv(table, f"{path}/{name}")
    return tables


@dataclass(frozen=True)
class Calibration:
    chosen: Calibrator
    metrics: dict[str, CalibrationMetrics]
    fitted_on: dict


def with_calibrated(df: DataFrame, isotonic: Calibrator, platt: Calibrator) -> DataFrame:
    return platt.transform(isotonic.transform(df, "score", "isotonic"), "score", "platt").withColumn(
        "raw", F.col("score")
    )


def calibrate(scores: DataFrame) -> Calibration:
    """Fit both calibrators on the first 80% by time, measure them on the rest, choose one."""
    split = positional_split(typed_scores(scores))
    train, hold = (side.filter(F.col("score").isNotNull()) for side in (split.head, split.tail))
    blocks = stored(score_blocks(train), "blocks")
    rows = require_both_classes(blocks)
    isotonic, platt = isotonic_from_blocks(blocks), platt_from_blocks(blocks)
    calibrated = stored(with_calibrated(hold, isotonic, platt), "holdout")
    metrics = calibration_metrics(calibrated, ["raw", "isotonic", "platt"])
    kind = choose_calibrator(metrics["raw"], metrics["isotonic"], metrics["platt"])
    bounds = [side.agg(F.min("time"), F.max("time"), F.count(F.lit(1))).first() for side in (train, calibrated)]
    fitted_on = {
        "train_time_start": str(bounds[0][0]),
        "train_time_end": str(bounds[0][1]),
        "hold_time_start": str(bounds[1][0]),
        "hold_time_end": str(bounds[1][1]),
        "n_train": rows,
        "n_holdout": bounds[1][2],
    }
    return Calibration(isotonic if kind == ISOTONIC else platt, metrics, fitted_on)


def save_calibration(calibration: Calibration, path: str, spark: SparkSession, run_id: str) -> None:
    metrics = {k: {"brier": m.brier, "ece": m.ece, "topk": m.topk} for k, m in calibration.metrics.items()}
    calibration.chosen.save(
        path, spark, {"run_id": run_id, "fitted_on": calibration.fitted_on, "metrics": metrics}
    )


def curves_after_calibration(calibrated: DataFrame) -> DataFrame:
    """ROC-AUC and average precision of the raw and the calibrated scores, one row each."""
    rows = [
        curve_summary(calibrated, column, "y").select(F.lit(name).alias("score_name"), "roc_auc", "average_precision")
        for name, column in (("raw", "score"), ("calibrated", "p_cal"))
    ]
    return rows[0].unionByName(rows[1])


def decide(
    scores: DataFrame, calibrator: Calibrator, run_id: str, run_folder: str, points_path: str, window: str = "full"
) -> DataFrame:
    """Apply a calibrator, check and store the probabilities, and update the operating points of the run.

    The full window includes the rows the calibrator was fitted on; ``holdout`` is the last 20% by time. Beside
    the points, ``curves_after.parquet`` (raw and calibrated side by side) and ``badges.parquet`` (whether
    the points move as they should) are written to the run folder.
    """
    typed = typed_scores(scores).filter(F.col("score").isNotNull())
    path = write_parquet(calibrator.transform(typed), f"{run_folder}/{CALIBRATED_SCORES}.parquet")
    calibrated = scores.sparkSession.read.parquet(path)
    enforce(probability_checks(calibrated))
    rows = positional_split(calibrated).tail if window == "holdout" else calibrated
    upsert_points(operating_points(rows, run_id, calibrator.kind, window), points_path)
    key = {"run_id": run_id, "calibrator": calibrator.kind, "window": window}
    stored_points = read_points(scores.sparkSession, points_path)
    for name, value in key.items():
        stored_points = stored_points.filter(F.col(name) == value)
    write_parquet(curves_after_calibration(rows), f"{run_folder}/curves_after.parquet")
    write_parquet(monotone_badges(stored_points), f"{run_folder}/badges.parquet")
    return stored_points
