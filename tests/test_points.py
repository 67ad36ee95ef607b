import math

import numpy as np
import pytest
from brute import fpr_points, random_scores, sort_alerts, to_spark, topk_points
from pyspark.sql import functions as F

from alertline.operators import curves, points
from alertline.operators.boost import class_weight

PERCENTS = (0.1, 0.5, 1.0, 2.0)
POINT = ("K_or_FPR", "threshold", "precision", "recall", "fpr", "alerts", "alerts_per_day")


def collected(df):
    return [tuple(r[c] for c in POINT) for r in df.orderBy("K_or_FPR").collect()]


def assert_close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert [v is None for v in g] == [v is None for v in w], (g, w)
        assert all(a is None or math.isclose(a, b, abs_tol=1e-12) for a, b in zip(g, w)), (g, w)


@pytest.mark.parametrize("seed, digits, nulls", [(1, None, 0.0), (2, 2, 0.0), (3, 1, 0.0), (4, 2, 0.3), (5, 0, 0.1)])
def test_points_equal_brute_force(spark, seed, digits, nulls):
    pdf = random_scores(seed, digits=digits, nulls=nulls)
    df = to_spark(spark, pdf)
    budgets = (0.1, 0.5, 5.0, 50.0, 100.0)
    assert_close(collected(points.fpr_rows(df, budgets)), fpr_points(pdf, budgets))
    assert_close(collected(points.fpr_blocks(df, budgets)), fpr_points(pdf, budgets, width=1e-12))
    percents = (0.5, 1.0, 20.0, 60.0)
    assert_close(collected(points.topk_table(df, percents)), topk_points(pdf, percents))


def test_chained_near_ties(spark):
    """Scores 4e-13 apart form one block by chaining, although its ends are farther apart than 1e-12."""
    pdf = random_scores(11, n=200)
    score = np.sort(pdf["score"].to_numpy())[::-1].copy()
    for start in (0, 20, 60):
        score[start : start + 15] = score[start] - np.arange(15) * 4e-13
    pdf["score"] = score
    pdf["y"] = (np.arange(200) % 3 == 0).astype(int)
    df = to_spark(spark, pdf)
    budgets = (0.1, 2.0, 8.0, 12.0, 34.0, 40.0)
    assert_close(collected(points.fpr_blocks(df, budgets)), fpr_points(pdf, budgets, width=1e-12))
    ends = curves.tie_block_staircase(df).count()
    assert ends == 200 - 3 * 14


@pytest.mark.parametrize("label", [0, 1])
def test_single_class(spark, label):
    pdf = random_scores(6, n=80).assign(y=label)
    df = to_spark(spark, pdf)
    assert_close(collected(points.fpr_rows(df)), fpr_points(pdf, PERCENTS))
    assert_close(collected(points.fpr_blocks(df)), fpr_points(pdf, PERCENTS, width=1e-12))
    assert curves.roc_auc(df).first()[0] is None


def test_constant_and_missing_scores(spark):
    pdf = random_scores(7, n=120)
    for value in (0.5, float("nan")):
        case = pdf.assign(score=value)
        df = to_spark(spark, case)
        assert_close(collected(points.fpr_rows(df)), fpr_points(case, PERCENTS))
        assert_close(collected(points.fpr_blocks(df)), fpr_points(case, PERCENTS, width=1e-12))


def test_empty_window(spark):
    df = to_spark(spark, random_scores(8, n=5)).filter("id < 0")
    assert points.topk_table(df).isEmpty()
    assert points.fpr_rows(df).isEmpty()
    assert points.fpr_blocks(df).isEmpty()
    assert points.precision_at_k(df).isEmpty()
    assert points.operating_points(df.withColumnRenamed("score", "p_cal"), "r", "platt").isEmpty()
    assert curves.best_f1(df).isEmpty()


def test_strictly_monotone_change_of_scores(spark):
    pdf = random_scores(9)
    df = to_spark(spark, pdf)
    moved = df.withColumn("score", F.col("score") * 3 + 1)
    keep = ("K_or_FPR", "precision", "recall", "alerts")
    for operator in (points.topk_table, points.fpr_blocks):
        assert operator(df).select(*keep).collect() == operator(moved).select(*keep).collect()
    assert curves.curve_summary(df).first() == curves.curve_summary(moved).first()


def test_row_form_finds_at_least_as_much_as_block_form(spark):
    df = to_spark(spark, random_scores(10, n=2000, digits=2))
    by_row = [r["recall"] for r in points.fpr_rows(df).orderBy("K_or_FPR").collect()]
    by_block = [r["recall"] for r in points.fpr_blocks(df).orderBy("K_or_FPR").collect()]
    assert all(a >= b for a, b in zip(by_row, by_block))


def test_roc_auc_equals_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = to_spark(spark, random_scores(12, n=1500, digits=2))
    mllib = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0).evaluate(df)
    assert math.isclose(curves.roc_auc(df).first()[0], mllib, rel_tol=1e-12)


def test_selection_flag(spark):
    pdf = random_scores(13, digits=1)
    flagged = points.flag_topk(to_spark(spark, pdf), 7.0)
    expected = set(sort_alerts(pdf)["id"].iloc[: math.ceil(0.07 * len(pdf))])
    assert {r["id"] for r in flagged.filter("selected").collect()} == expected


def test_best_f1_prefers_the_lowest_threshold(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0), (0.5, 0)], "score double, y int")
    # F1 is 2/3 at 0.9 and 4/5 at 0.7
    assert curves.best_f1(df).first()["threshold"] == 0.7
    tied = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 0), (0.6, 1)], "score double, y int")
    # F1 is 2/3 at both 0.9 and 0.6
    assert curves.best_f1(tied).first()["threshold"] == 0.6


# Published counts: 118,108 validation rows with 4,064 positives over 42 days.
ROWS, POSITIVES, NEGATIVES, DAYS = 118_108, 4_064, 114_044, 42


def test_published_counts():
    assert [points.ceil_count(k, ROWS) for k in (0.5, 1, 2, 5)] == [591, 1182, 2363, 5906]
    assert [points.floor_count(k, ROWS) for k in (0.005, 0.01, 0.02, 0.05)] == [590, 1181, 2362, 5905]
    assert [points.allowed_negatives(b, NEGATIVES) for b in (0.001, 0.005, 0.01, 0.02)] == [114, 570, 1140, 2280]
    assert class_weight(16_599, 455_833) == 27.46
    assert points.floor_count(0.001, 10) == 1


@pytest.mark.parametrize(
    "tp, fp, precision, recall, fpr, alerts_per_day",
    [
        (871, 95, 0.901656314699793, 0.2143208661417323, 0.0008330118199992985, 23.0),
        (1507, 570, 0.725565719788156, 0.3708169291338583, 0.004998070919995791, 49.45238095238095),
        (550, 41, 0.9306260575296108, 0.13533464566929135, 0.0003595103644207499, 14.071428571428571),
    ],
)
def test_published_operating_rows(spark, tp, fp, precision, recall, fpr, alerts_per_day):
    """The published rows follow from whole counts by the formulas of the result table."""
    from alertline.functions import ratio

    row = (
        spark.range(1)
        .select(
            ratio(F.lit(tp), F.lit(tp + fp)),
            ratio(F.lit(tp), F.lit(POSITIVES)),
            ratio(F.lit(fp), F.lit(NEGATIVES)),
            ratio(F.lit(tp + fp), F.lit(DAYS)),
        )
        .first()
    )
    assert tuple(row) == (precision, recall, fpr, alerts_per_day)


def test_threshold_metrics_published(spark):
    """Confusion counts 2994 / 10015 / 104029 / 1070 give the published rates."""
    counts = spark.createDataFrame(
        [(0.9, 1, 2994), (0.9, 0, 10_015), (0.1, 0, 104_029), (0.1, 1, 1070)], "score double, y int, n int"
    )
    df = counts.select("score", "y", F.explode(F.sequence(F.lit(1), "n")))
    row = curves.threshold_metrics(df, [0.5]).first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (2994, 10_015, 104_029, 1070)
    assert math.isclose(row["precision"], 0.23014835882850335, rel_tol=1e-15)
    assert math.isclose(row["recall"], 0.7367125984251969, rel_tol=1e-15)
    assert math.isclose(row["f1"], 0.3507292215779301, rel_tol=1e-15)


def equal_rows(spark, n, labels):
    """``n`` rows, the first ones equal in (score, time, id) with the given labels."""
    rows = [(0, 0.9, y) for y in labels] + [(k + 1, 0.5 - k / 100, k % 2) for k in range(n - len(labels))]
    df = spark.createDataFrame(rows, "id bigint, score double, y int")
    return df.withColumn("time", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def test_topk_takes_exactly_k_of_equal_rows(spark):
    df = equal_rows(spark, 20, [1, 1, 1, 0, 1, 1])
    assert points.flag_topk(df, 10.0).filter("selected").count() == 2
    assert points.flag_topk(df, 40.0).filter("selected").count() == 8
    rows = {r["K_or_FPR"]: r for r in points.topk_table(df, (10.0, 30.0, 250.0)).collect()}
    assert (rows[10.0]["alerts"], rows[10.0]["precision"], rows[10.0]["threshold"]) == (2, 0.5, 0.9)
    assert (rows[30.0]["alerts"], rows[30.0]["precision"]) == (6, 5 / 6)
    assert (rows[250.0]["alerts"], rows[250.0]["recall"]) == (20, 1.0)
    got = points.precision_at_k(df, (0.1, 0.3)).orderBy("share").collect()
    assert [r["precision"] for r in got] == [0.5, 5 / 6]


def test_fpr_rows_spend_the_budget_on_equal_rows(spark):
    df = equal_rows(spark, 20, [0, 0, 0, 0, 0, 0])
    negatives = df.filter("y = 0").count()
    row = points.fpr_rows(df, (20.0,)).first()
    assert (negatives, row["alerts"], row["threshold"]) == (13, 2, 0.9)


def test_nan_scores_are_missing(spark):
    df = equal_rows(spark, 20, [1, 0]).withColumn("score", F.when(F.col("id") > 15, math.nan).otherwise(F.col("score")))
    plain = df.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    for table in (points.topk_table, points.fpr_rows, points.fpr_blocks, points.precision_at_k, points.recall_at_fpr):
        assert table(df).collect() == table(plain).collect()
    assert points.flag_topk(df, 10.0).filter("selected").count() == 2
    assert points.flag_topk(df, 10.0).filter("selected").agg(F.min("score")).first()[0] == 0.9


def test_positional_split_of_equal_rows(spark):
    from alertline.operators.splits import positional_split

    df = equal_rows(spark, 20, [1, 0, 1, 0, 1, 0]).withColumn("id", 100 - F.col("id"))
    split = positional_split(df)
    assert (split.head.count(), split.tail.count()) == (16, 4)
    assert split.tail.filter("id = 100").count() == 4
