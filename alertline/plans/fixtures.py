"""Score and transaction tables derived from the test tables by plain expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertline.session import use_utc

_COUNTER = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_LABEL = f"CASE WHEN value * (1 + {_COUNTER} % 3) > 250 THEN 1 ELSE 0 END"
ORIGIN_SECONDS = 1_704_067_200  # 2024-01-01


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{folder}/{name}.parquet")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """(id, time, y, score), one row per event."""
    return table(spark, folder, "events").selectExpr(
        "event_id AS id", "ts AS time", f"{_LABEL} AS y", "value / (value + 50) AS score"
    )


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """A raw transaction table with sentinels, a sparse column and seconds since the origin."""
    return table(spark, folder, "events").selectExpr(
        "event_id AS TransactionID",
        "CASE WHEN event_id % 13 = 0 THEN -1.0D WHEN event_id % 17 = 0 THEN -999.0D ELSE value END AS TransactionAmt",
        "CASE WHEN event_id % 5 = 0 THEN 'missing' ELSE event_type END AS ProductCD",
        "CASE WHEN event_id % 20 = 0 THEN value END AS sparse95",
        "CASE WHEN event_id % 10 = 0 THEN value END AS sparse90",
        f"{_LABEL} AS isFraud",
        f"{_COUNTER} AS C1",
        "CONCAT('v', CAST(user_id * 10 + event_id % 10 AS STRING)) AS DeviceInfo",
        "ts",
        f"unix_seconds(CAST(ts AS TIMESTAMP)) - {ORIGIN_SECONDS} AS TransactionDT",
    )


def heavy_ties(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines scored by their discount: a handful of distinct scores over all rows."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_shipdate").alias("time"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_discount").alias("score"),
    )
