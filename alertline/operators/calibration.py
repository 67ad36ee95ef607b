"""Probability calibration: fit, apply, measure, choose."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertline.operators.curves import score_blocks
from alertline.operators.points import topk_precisions
from alertline.operators.quantile import exact_quantiles
from alertline.session import stored

ISOTONIC, PLATT = "isotonic", "platt"
HEAD_PERCENT = 1.0
HEAD_LOSS_LIMIT = 0.02
BRIER_SLACK = 2e-12
NEWTON_STEPS = 50
HALVINGS = 30
GRADIENT_GOAL = 1e-14  # for each row
GRADIENT_LIMIT = 1e-9  # good enough where rounding keeps it from falling further
LOSS_SLACK = 1e-12
MAX_STEPS = 4_000_000  # pooled steps of an isotonic fit that meet in a task or in a model
STEPS = "part long, lo double, hi double, n long, tp long"


def brier_column(p: str, y: str = "y") -> Column:
    return F.avg(F.pow(F.col(p).cast("double") - F.col(y).cast("double"), 2))


def brier(df: DataFrame, scores: Sequence[str], y: str = "y") -> DataFrame:
    """Mean squared difference of probability and label, one row per probability column."""
    values = df.agg(*[brier_column(p, y).alias(f"_b{i}") for i, p in enumerate(scores)])
    rows = [F.struct(F.lit(p).alias("score_name"), F.col(f"_b{i}").alias("brier")) for i, p in enumerate(scores)]
    return values.select(F.inline(F.array(*rows)))


def uniform_edges(bins: int) -> list[float]:
    """Interior edges of equal-width bins on [0, 1]."""
    return [float(e) for e in np.linspace(0.0, 1.0, bins + 1)[1:-1]]


def quantile_edges(df: DataFrame, p: str, bins: int) -> list[float] | None:
    """Interior distinct quantile edges; None if all probabilities are equal."""
    shares = [float(q) for q in np.linspace(0.0, 1.0, bins + 1)]
    edges = sorted({e for e in exact_quantiles(df, {p: shares})[p] if e is not None})
    return edges[1:-1] if len(edges) >= 2 else None


def _with_bin(df: DataFrame, p: str, edges: Sequence[float]) -> DataFrame:
    """``bin``: the number of edges below the probability, so bins are closed on the right."""
    if not edges:
        return df.withColumn("bin", F.lit(0))
    splits = [-math.inf, *[math.nextafter(e, math.inf) for e in edges], math.inf]
    binned = Bucketizer(splits=splits, inputCol=p, outputCol="_bin").transform(df)
    return binned.withColumn("bin", F.col("_bin").cast("int")).drop("_bin")


def reliability(df: DataFrame, p: str, y: str = "y", bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """Mean probability, mean label and rows per non-empty bin; no rows for one-valued quantile bins."""
    data = df.select(F.col(p).cast("double").alias("_p"), F.col(y).cast("double").alias("_y")).filter("_p is not null")
    edges = uniform_edges(bins) if strategy == "uniform" else quantile_edges(data, "_p", bins)
    table = _with_bin(data, "_p", edges or [])
    bars = table.groupBy("bin").agg(
        F.avg("_p").alias("p_mean"), F.avg("_y").alias("y_mean"), F.count(F.lit(1)).alias("n")
    )
    return bars.filter(F.lit(edges is not None))


def reliability_by_score(df: DataFrame, scores: Sequence[str], y: str = "y", bins: int = 10) -> DataFrame:
    """Uniform-bin reliability of several probability columns, from one pass over the rows."""
    pairs = [F.struct(F.lit(p).alias("score_name"), F.col(p).cast("double").alias("_p")) for p in scores]
    long = df.select(F.col(y).cast("double").alias("_y"), F.inline(F.array(*pairs))).filter("_p is not null")
    return (
        _with_bin(long, "_p", uniform_edges(bins))
        .groupBy("score_name", "bin")
        .agg(F.avg("_p").alias("p_mean"), F.avg("_y").alias("y_mean"), F.count(F.lit(1)).alias("n"))
    )


def ece_column() -> Column:
    """Expected calibration error over the bars of a reliability table."""
    gap = F.col("n") * F.abs(F.col("p_mean") - F.col("y_mean"))
    return F.coalesce(F.sum(gap) / F.sum("n"), F.lit(0.0))


def ece(df: DataFrame, p: str, y: str = "y", bins: int = 10, strategy: str = "uniform") -> DataFrame:
    return reliability(df, p, y, bins, strategy).agg(ece_column().alias("ece"))


@dataclass(frozen=True)
class Calibrator:
    """A fitted calibrator: isotonic knots (kept in an MLlib model) or two logistic coefficients."""

    kind: str
    model: IsotonicRegressionModel | tuple[float, float]

    def transform(self, df: DataFrame, score: str = "score", output: str = "p_cal") -> DataFrame:
        """Add the calibrated probability. Nothing is fitted here; a missing score stays missing."""
        value = F.col(score).cast("double")
        if self.kind == PLATT:
            slope, intercept = self.model
            return df.withColumn(output, F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(slope) * value + F.lit(intercept)))))
        fed = df.withColumn("_score", F.coalesce(value, F.lit(0.0)))
        applied = self.model.setFeaturesCol("_score").setPredictionCol("_p").transform(fed)
        return applied.withColumn(output, F.when(F.col(score).isNotNull(), F.col("_p"))).drop("_score", "_p")

    def save(self, path: str, spark: SparkSession, metadata: Mapping | None = None) -> None:
        slope, intercept = self.model if self.kind == PLATT else (None, None)
        spark.createDataFrame(
            [(self.kind, slope, intercept, json.dumps(dict(metadata or {})))],
            "kind string, slope double, intercept double, metadata string",
        ).write.mode("overwrite").json(f"{path}/calibrator")
        if self.kind == ISOTONIC:
            self.model.write().overwrite().save(f"{path}/isotonic")

    @staticmethod
    def load(path: str, spark: SparkSession) -> tuple[Calibrator, dict]:
        schema = "kind string, slope double, intercept double, metadata string"
        row = spark.read.schema(schema).json(f"{path}/calibrator").first()
        if row is None or row["kind"] not in (ISOTONIC, PLATT):
            raise ValueError(f"no calibrator of a known kind at {path}")
        if row["kind"] == PLATT:
            model = (row["slope"], row["intercept"])
        else:
            model = IsotonicRegressionModel.load(f"{path}/isotonic")
        return Calibrator(row["kind"], model), json.loads(row["metadata"])


def require_both_classes(blocks: DataFrame) -> int:
    """Rows of a calibration window given as score blocks; fails unless both classes occur."""
    rows, positives = blocks.agg(F.sum("blk_n"), F.sum("blk_tp")).first()
    if not positives or positives == rows:
        raise ValueError("the calibration window lacks positives or negatives")
    return rows


def fit_isotonic(df: DataFrame, score: str = "score", y: str = "y") -> Calibrator:
    """Non-decreasing step fit, clipped at the ends and linear between knots."""
    return isotonic_from_blocks(score_blocks(df, score, y), score)


def isotonic_from_blocks(blocks: DataFrame, score: str = "score") -> Calibrator:
    """The isotonic fit of one weighted point per distinct score.

    Only the knots of the pooled steps, which are counted first, meet in one place.
    """
    points = blocks.select(F.col(score).cast("double").alias("lo"), F.col("blk_n").alias("n"), F.col("blk_tp").alias("tp"))
    steps = pooled_steps(points)
    count = steps.count()
    if count > MAX_STEPS:
        raise ValueError(f"the isotonic fit has {count} steps, more than a model can hold ({MAX_STEPS})")
    ends = F.array_distinct(F.array("lo", "hi"))
    knots = steps.select(F.explode(ends).alias("features"), (F.col("tp") / F.col("n")).alias("label"))
    return Calibrator(ISOTONIC, IsotonicRegression(isotonic=True).fit(knots))


def pooled_steps(points: DataFrame) -> DataFrame:
    """The steps of the isotonic fit of points (lo, n, tp): part, lo, hi (scores), n and tp, with rising tp / n.

    Each range of scores is pooled by itself: a stack of steps, the last of which takes in its neighbour as long
    as the neighbour's mean is not lower. Pooled steps are points to pool again, so ranges can be joined: as
    long as some step at the end of a range is not below the first one of the next, neighbouring ranges are
    pooled together, twice as many in each round. Means are compared as fractions of whole numbers. An empty
    table has no steps.
    """
    points = points.select("lo", F.col("lo").alias("hi"), F.col("n").cast("long").alias("n"), F.col("tp").cast("long").alias("tp"))
    ranged = points.repartitionByRange("lo").withColumn("part", F.spark_partition_id().cast("long"))
    steps = stored(ranged.sortWithinPartitions("lo").select("part", "lo", "hi", "n", "tp").mapInArrow(_pool, STEPS), "steps")
    together = 1
    while True:
        mean = F.struct("n", "tp")
        ends = steps.groupBy("part").agg(
            F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"), F.count(F.lit(1)).alias("steps")
        )
        parts = sorted(ends.collect())  # a row for each range
        if not any(a["last"]["tp"] * b["first"]["n"] >= b["first"]["tp"] * a["last"]["n"] for a, b in zip(parts, parts[1:])):
            return steps
        together *= 2
        sizes: dict[int, int] = {}
        for row in parts:
            sizes[row["part"] // together] = sizes.get(row["part"] // together, 0) + row["steps"]
        if max(sizes.values()) > MAX_STEPS:
            raise ValueError(f"{max(sizes.values())} steps would meet in one task, more than {MAX_STEPS}")
        joined = steps.withColumn("part", F.floor(F.col("part") / together) * together).repartition("part")
        steps = stored(joined.sortWithinPartitions("part", "lo").mapInArrow(_pool, STEPS), "steps")


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pool sorted steps, each part by itself."""
    stack: list[tuple[int, float, float, int, int]] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*stack))
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["part", "lo", "hi", "n", "tp"])

    for some in batches:
        for part, lo, hi, n, tp in zip(*(some.column(k).to_pylist() for k in range(5))):
            if stack and stack[-1][0] != part:
                yield batch()
                stack = []
            while stack and stack[-1][4] * n >= tp * stack[-1][3]:
                _, lo, _, more, more_tp = stack.pop()
                n, tp = n + more, tp + more_tp
            stack.append((part, lo, hi, n, tp))
    if stack:
        yield batch()


def fit_platt(df: DataFrame, score: str = "score", y: str = "y", c: float = 1.0) -> Calibrator:
    """Logistic regression on the score with an L2 penalty of strength 1/c on the slope only."""
    return platt_from_blocks(stored(score_blocks(df, score, y), "blocks"), score, c)


def platt_from_blocks(blocks: DataFrame, score: str = "score", c: float = 1.0) -> Calibrator:
    """The logistic fit of one weighted point per distinct score, by Newton steps.

    A step is one aggregation over the blocks. It is halved as long as it raises the objective; the fit ends
    when the gradient is as good as zero, and fails if that is not reached.
    """
    slope, intercept, before = 0.0, 0.0, math.inf
    at = _logistic(blocks, score, c, slope, intercept)
    for _ in range(NEWTON_STEPS):
        gradient = max(abs(at["ga"]), abs(at["gb"])) / at["rows"]
        if gradient <= GRADIENT_GOAL or gradient <= GRADIENT_LIMIT and gradient >= before:
            return Calibrator(PLATT, (slope, intercept))
        before = gradient
        determinant = at["haa"] * at["hbb"] - at["hab"] ** 2
        step = (
            (at["hbb"] * at["ga"] - at["hab"] * at["gb"]) / determinant,
            (at["haa"] * at["gb"] - at["hab"] * at["ga"]) / determinant,
        )
        for _ in range(HALVINGS):
            new = _logistic(blocks, score, c, slope - step[0], intercept - step[1])
            if new["loss"] <= at["loss"] + LOSS_SLACK * abs(at["loss"]):
                break
            step = (step[0] / 2, step[1] / 2)
        slope, intercept, at = slope - step[0], intercept - step[1], new
    raise ValueError("the logistic fit did not reach a zero gradient")


def _logistic(blocks: DataFrame, score: str, c: float, slope: float, intercept: float) -> dict[str, float]:
    """Objective, gradient and second derivatives of the penalised logistic loss, and the number of rows."""
    x, n, tp = F.col(score).cast("double"), F.col("blk_tp") + F.col("blk_fp"), F.col("blk_tp")
    z = F.lit(slope) * x + F.lit(intercept)
    points = blocks.select(x.alias("x"), n.cast("double").alias("n"), tp.cast("double").alias("tp"), z.alias("z"))
    p = 1 / (1 + F.exp(-F.col("z")))
    points = points.withColumn("off", F.col("n") * p - F.col("tp")).withColumn("h", F.col("n") * p * (1 - p))
    loss = F.col("n") * (F.log1p(F.exp(-F.abs("z"))) + F.greatest("z", F.lit(0.0))) - F.col("tp") * F.col("z")
    row = points.agg(
        F.sum("n").alias("rows"),
        F.sum(loss).alias("loss"),
        F.sum(F.col("off") * F.col("x")).alias("ga"),
        F.sum("off").alias("gb"),
        F.sum(F.col("h") * F.col("x") * F.col("x")).alias("haa"),
        F.sum(F.col("h") * F.col("x")).alias("hab"),
        F.sum("h").alias("hbb"),
    ).first()
    at = row.asDict()
    at["loss"] += slope * slope / (2 * c)
    at["ga"] += slope / c
    at["haa"] += 1 / c
    return at


@dataclass(frozen=True)
class CalibrationMetrics:
    """Brier, ECE and top-K% precision of one probability column on the holdout."""

    name: str
    brier: float
    ece: float
    topk: dict[float, float | None]


def calibration_metrics(
    holdout: DataFrame, scores: Sequence[str], y: str = "y", bins: int = 10
) -> dict[str, CalibrationMetrics]:
    errors = {r["score_name"]: r["brier"] for r in brier(holdout, scores, y).collect()}
    gaps = reliability_by_score(holdout, scores, y, bins).groupBy("score_name").agg(ece_column().alias("ece"))
    eces = {r["score_name"]: r["ece"] for r in gaps.collect()}
    heads: dict[str, dict[float, float | None]] = {s: {} for s in scores}
    for r in topk_precisions(holdout, scores, y=y).collect():
        heads[r["score_name"]][r["K"]] = r["precision"]
    return {s: CalibrationMetrics(s, errors[s], eces.get(s, 0.0), heads[s]) for s in scores}


def choose_calibrator(raw: CalibrationMetrics, isotonic: CalibrationMetrics, platt: CalibrationMetrics) -> str:
    """Lower Brier wins (Platt if equal), unless it loses too much top-1% precision and the other does not."""
    best = ISOTONIC if isotonic.brier < platt.brier - BRIER_SLACK else PLATT
    head = {k: m.topk.get(HEAD_PERCENT) for k, m in (("raw", raw), (ISOTONIC, isotonic), (PLATT, platt))}
    if any(v is None or math.isnan(v) for v in head.values()):
        return best

    def keeps_head(kind: str) -> bool:
        return head["raw"] - head[kind] <= HEAD_LOSS_LIMIT

    other = PLATT if best == ISOTONIC else ISOTONIC
    return other if not keeps_head(best) and keeps_head(other) else best


def metrics_table(spark: SparkSession, metrics: Sequence[CalibrationMetrics]) -> DataFrame:
    """The calibration report: one row per probability column."""
    percents = sorted({k for m in metrics for k in m.topk})
    return spark.createDataFrame(
        [(m.name, m.brier, m.ece, *[m.topk.get(k) for k in percents]) for m in metrics],
        "score_name string, brier double, ece double, "
        + ", ".join(f"top_{str(k).replace('.', '_')} double" for k in percents),
    )
