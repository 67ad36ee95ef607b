import math

import numpy as np
import pytest
from brute import random_scores, to_spark
from pyspark.sql import functions as F

from alertline.operators import calibration as cal
from alertline.operators.calibration import CalibrationMetrics, Calibrator, choose_calibrator
from alertline.operators.curves import score_blocks
from alertline.operators.quality import QualityError, enforce, monotone_drops, probability_checks
from alertline.plans import decisions
from alertline.session import scratch_path
from alertline.sources import sinks


@pytest.fixture(scope="module")
def pdf():
    return random_scores(21, n=1500, digits=2)


@pytest.fixture(scope="module")
def df(spark, pdf):
    return to_spark(spark, pdf).cache()


def pool_adjacent(points):
    """Isotonic fit of (value, mean, weight) points by pooling neighbours that fall."""
    blocks = []
    for value, mean, weight in points:
        blocks.append([mean, weight, [value]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            mean, weight, values = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + mean * weight) / (last[1] + weight)
            last[1] += weight
            last[2] += values
    return {v: m for m, _, values in blocks for v in values}


def test_isotonic_equals_pooling(spark, pdf, df):
    grouped = pdf.groupby("score")["y"].agg(["mean", "size"]).reset_index()
    expected = pool_adjacent(grouped.itertuples(index=False, name=None))
    fitted = cal.fit_isotonic(df)
    for row in fitted.transform(df.select("score").distinct()).collect():
        assert math.isclose(row["p_cal"], expected[row["score"]], abs_tol=1e-12)


@pytest.mark.parametrize("shape", ["rising", "falling", "waves", "one", "ties"])
def test_pooling_in_rounds_equals_pooling_in_one_go(spark, shape):
    """Ranges are pooled on their own and joined until no neighbours fall; falling points become one step."""
    n = 1 if shape == "one" else 800
    x = np.arange(n)
    share = {"rising": x / n, "falling": 1 - x / n, "waves": 0.5 + 0.4 * np.sin(x / 60), "one": x + 0.5, "ties": 0.5 + 0 * x}[shape]
    weight = 1 + x * 7919 % 13
    hits = np.round(share * weight).astype(int)
    points = [(float(a) / 7, int(w), int(h)) for a, w, h in zip(x, weight, hits)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        steps = cal.pooled_steps(spark.createDataFrame(points, "lo double, n long, tp long").repartition(5)).orderBy("lo").collect()
        none = cal.pooled_steps(spark.createDataFrame([], "lo double, n long, tp long"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = pool_adjacent((v, h / w, w) for v, w, h in points)
    means = {v: s["tp"] / s["n"] for s in steps for v, _, _ in points if s["lo"] <= v <= s["hi"]}
    assert means == pytest.approx(expected, abs=1e-12) and none.isEmpty()
    assert sum(s["n"] for s in steps) == weight.sum()
    assert all(a["tp"] * b["n"] < b["tp"] * a["n"] for a, b in zip(steps, steps[1:]))
    if shape in ("falling", "ties"):
        assert len(steps) <= 2 if shape == "falling" else len(steps) >= 1


def test_too_many_steps_are_refused(spark, df, monkeypatch):
    monkeypatch.setattr(cal, "MAX_STEPS", 2)
    with pytest.raises(ValueError, match="steps"):
        cal.fit_isotonic(df)


def test_isotonic_of_unrounded_scores(spark):
    pdf = random_scores(5, n=3000, digits=12)
    assert pdf["score"].nunique() > 2500
    frame = to_spark(spark, pdf)
    grouped = pdf.groupby("score")["y"].agg(["mean", "size"]).reset_index()
    expected = pool_adjacent(grouped.itertuples(index=False, name=None))
    got = {r["score"]: r["p_cal"] for r in cal.fit_isotonic(frame).transform(frame.select("score").distinct()).collect()}
    assert got == pytest.approx(expected, abs=1e-12)


def test_isotonic_clips_and_keeps_missing(spark, df, pdf):
    fitted = cal.fit_isotonic(df)
    probe = spark.createDataFrame([(-5.0,), (5.0,), (None,)], "score double")
    low, high, missing = (r["p_cal"] for r in fitted.transform(probe).collect())
    ends = fitted.transform(df).agg(F.min("p_cal"), F.max("p_cal")).first()
    assert (low, high) == tuple(ends) and missing is None


def test_platt_gradient_is_zero(pdf, df):
    slope, intercept = cal.fit_platt(df).model
    s, y = pdf["score"].to_numpy(), pdf["y"].to_numpy()
    gap = 1 / (1 + np.exp(-(slope * s + intercept))) - y
    assert abs(gap.sum()) < 1e-4
    assert abs((gap * s).sum() + slope) < 1e-4  # the penalty is half the squared slope


def test_metrics_equal_numpy(pdf, df):
    p, y = pdf["score"].to_numpy(), pdf["y"].to_numpy()
    assert math.isclose(cal.brier(df, ["score"]).first()["brier"], ((p - y) ** 2).mean(), rel_tol=1e-12)
    for strategy in ("uniform", "quantile"):
        edges = np.linspace(0, 1, 11) if strategy == "uniform" else np.unique(np.quantile(p, np.linspace(0, 1, 11)))
        bins = np.searchsorted(edges[1:-1], p, side="left")
        expected = sum(
            (bins == b).mean() * abs(p[bins == b].mean() - y[bins == b].mean()) for b in np.unique(bins)
        )
        assert math.isclose(cal.ece(df, "score", strategy=strategy).first()["ece"], expected, rel_tol=1e-9)
        bars = cal.reliability(df, "score", strategy=strategy).orderBy("bin").collect()
        assert [r["n"] for r in bars] == [int((bins == b).sum()) for b in np.unique(bins)]


def test_constant_probability_has_no_quantile_bars(spark):
    df = spark.createDataFrame([(0.3, 1), (0.3, 0)], "score double, y int")
    assert cal.reliability(df, "score", strategy="quantile").isEmpty()
    assert cal.ece(df, "score", strategy="quantile").first()["ece"] == 0.0


def metrics(name, brier, head):
    return CalibrationMetrics(name, brier, 0.0, {0.5: 1.0, 1.0: head})


@pytest.mark.parametrize(
    "isotonic, platt, raw_head, expected",
    [
        ((0.02, 0.9), (0.03, 0.9), 0.9, "isotonic"),
        ((0.03, 0.9), (0.02, 0.9), 0.9, "platt"),
        ((0.02, 0.9), (0.02, 0.9), 0.9, "platt"),
        ((0.02, 0.9), (0.02 + 1e-12, 0.9), 0.9, "platt"),
        ((0.02, 0.80), (0.03, 0.9), 0.9, "platt"),
        ((0.03, 0.9), (0.02, 0.80), 0.9, "isotonic"),
        ((0.02, 0.80), (0.03, 0.80), 0.9, "isotonic"),
        ((0.02, 0.80), (0.03, 0.9), None, "isotonic"),
        ((0.02, 0.80), (0.03, 0.9), float("nan"), "isotonic"),
    ],
)
def test_choice_rule(isotonic, platt, raw_head, expected):
    chosen = choose_calibrator(
        metrics("raw", 0.08, raw_head), metrics("isotonic", *isotonic), metrics("platt", *platt)
    )
    assert chosen == expected


@pytest.mark.parametrize("kind", ["isotonic", "platt"])
def test_save_and_load(spark, df, kind):
    fitted = (cal.fit_isotonic if kind == "isotonic" else cal.fit_platt)(df)
    path = scratch_path(spark, "calibrator")
    fitted.save(path, spark, {"run_id": "r1"})
    loaded, about = Calibrator.load(path, spark)
    assert (loaded.kind, about) == (kind, {"run_id": "r1"})
    gap = fitted.transform(df, output="a").drop("time").join(loaded.transform(df, output="b").select("id", "b"), "id")
    assert gap.filter("a <> b").isEmpty()


def test_one_class_cannot_be_calibrated(df):
    with pytest.raises(ValueError):
        cal.require_both_classes(score_blocks(df.filter("y = 0")))
    assert cal.require_both_classes(score_blocks(df)) == 1500


def test_from_scores_to_decisions(spark, df):
    fitted = decisions.calibrate(df)
    assert fitted.fitted_on["n_train"] == 1200 and fitted.fitted_on["n_holdout"] == 300
    assert fitted.metrics["isotonic"].brier <= fitted.metrics["raw"].brier + 0.05
    folder = scratch_path(spark, "run")
    points = decisions.decide(df, fitted.chosen, "run_1", folder, f"{folder}/points")
    curves = {r["score_name"]: r for r in spark.read.parquet(f"{folder}/curves_after.parquet").collect()}
    assert set(curves) == {"raw", "calibrated"} and all(0.5 < r["roc_auc"] <= 1 for r in curves.values())
    assert spark.read.parquet(f"{folder}/badges.parquet").count() > 0
    assert points.count() == 8
    late = decisions.decide(df, fitted.chosen, "run_1", folder, f"{folder}/points", window="holdout")
    assert late.agg(F.max("alerts")).first()[0] < points.agg(F.max("alerts")).first()[0]
    stored = sinks.read_points(spark, f"{folder}/points").groupBy("window").count().collect()
    assert {tuple(r) for r in stored} == {("full", 8), ("holdout", 8)}
    decisions.save_calibration(fitted, f"{folder}/calibrator", spark, "run_1")
    assert Calibrator.load(f"{folder}/calibrator", spark)[1]["fitted_on"]["n_train"] == 1200
    topk, fpr = decisions.baseline_tables(df, folder)
    assert [t.count() for t in (topk, fpr)] == [4, 4]
    back = spark.read.option("header", True).csv(f"{folder}/top_k_table")
    assert back.columns == topk.columns and back.count() == 4


def test_probability_checks(spark):
    good = spark.createDataFrame([(0.1, 0.2), (0.2, 0.2), (0.3, 0.9)], "score double, p_cal double")
    enforce(probability_checks(good))
    falling = good.withColumn("p_cal", 1 - F.col("p_cal"))
    assert monotone_drops(falling, "p_cal").first()["drops"] == 1
    for bad in (falling, good.withColumn("p_cal", F.col("p_cal") * 2)):
        with pytest.raises(QualityError):
            enforce(probability_checks(bad))
