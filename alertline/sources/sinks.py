"""Writing results: parquet, CSV and JSON reports, keyed replacement, run metadata."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertline.operators.points import POINT_COLUMNS, POINT_KEY

POINT_SCHEMA = (
    "mode string, budget_type string, budget_value double, threshold_prob double, precision double, recall double, "
    "fpr double, alerts bigint, alerts_per_day double, run_id string, calibrator string, window string"
)


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """A result table as CSV with a header; timestamps keep their microseconds."""
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    writer = df.write.mode("overwrite").option("header", True)
    writer.option("timestampNTZFormat", micros).option("timestampFormat", f"{micros}XXX").csv(path)
    return path


def write_report(spark: SparkSession, report: Mapping, path: str) -> str:
    """One report as one JSON document."""
    text = spark.createDataFrame([(json.dumps(report),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(path)
    return path


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def upsert_points(points: DataFrame, path: str) -> None:
    """Replace the stored rows of every (run, calibrator, window) in ``points``; keep all others.

    The key is the partitioning of the table, so replaced rows are whole folders and nothing else is read.
    """
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*POINT_KEY).parquet(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POINT_SCHEMA).parquet(path).select(*POINT_COLUMNS)


def new_run_id(moment: datetime | None = None) -> str:
    return (moment or datetime.now()).strftime("%Y_%m_%d_%H_%M_%S")


def run_path(base: str, run_id: str) -> str:
    return f"{base.rstrip('/')}/run_{run_id}"


def run_metadata(scores: DataFrame, run_id: str, cut: str, time_column: str = "dt", y: str = "y") -> dict:
    """What a frozen score table was made from, and its rows, positives and prevalence."""
    rows, positives = scores.agg(F.count(F.lit(1)), F.coalesce(F.sum(y), F.lit(0))).first()
    return {
        "run_id": run_id,
        "score_type": "probability",
        "time_column": time_column,
        "t_cut": cut,
        "spark_version": pyspark.__version__,
        "rows_val": rows,
        "positives_val": int(positives),
        "prevalence_val": positives / rows if rows else float("nan"),
    }
