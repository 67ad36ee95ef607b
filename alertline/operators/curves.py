"""Threshold curves and the numbers read off them.

All of them start from score blocks, one row per distinct score, so that a score shared by
many rows is collapsed before anything is shuffled or ordered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertline.functions.scalar import ratio
from alertline.operators.order import Key, Ranges, alert_order, desc, find_ranges, running
from alertline.session import stored

TIE_WIDTH = 1e-12  # neighbouring probabilities this close count as one threshold
STAGE_ROWS = 1_000_000  # rows of one stage that one group orders
STAGE_CELLS = 2_000_000  # margins that a task holds before it packs them
STAGE_SAMPLE = 200  # sampled rows for each range of a stage


def positive(y: str = "y") -> Column:
    return F.coalesce(F.col(y) == 1, F.lit(False))


def negative(y: str = "y") -> Column:
    return F.coalesce(F.col(y) == 0, F.lit(False))


def row_staircase(df: DataFrame, keys: Sequence[Key] | None = None, y: str = "y") -> DataFrame:
    """Cumulative counts, precision, recall and FPR after every row of the alert order."""
    stairs = running(df, keys or alert_order(), {"tp": positive(y), "fp": negative(y)})
    return stairs.select(*df.columns, F.col("rank").alias("alerts"), "cum_tp", "cum_fp", *rates())


def rates() -> list[Column]:
    """Precision, recall and FPR of a staircase row; 0 where the denominator is 0."""
    return [
        ratio(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp")).alias("precision"),
        ratio(F.col("cum_tp"), F.col("all_tp")).alias("recall"),
        ratio(F.col("cum_fp"), F.col("all_fp")).alias("fpr"),
    ]


def score_blocks(df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Rows, positives and negatives per distinct score; rows without a score are left out."""
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(*by, F.col(score))
        .agg(
            F.count(F.lit(1)).alias("blk_n"),
            F.count_if(positive(y)).alias("blk_tp"),
            F.count_if(negative(y)).alias("blk_fp"),
        )
    )


def block_staircase(
    df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = (), ranges: Ranges | None = None
) -> DataFrame:
    """Cumulative counts at each distinct score, from the highest down.

    ``next_score`` is the next lower score, null at the lowest one.
    """
    rows = df.filter(F.col(score).isNotNull())
    return running(
        score_blocks(rows, score, y, by),
        [desc(score)],
        {"n": F.col("blk_n"), "tp": F.col("blk_tp"), "fp": F.col("blk_fp")},
        by=by,
        lead={"next_score": score},
        ranges=ranges or find_ranges(rows.select(score), [desc(score)]),
        source=(
            rows.select(*by, score, y),
            {"n": F.lit(1), "tp": positive(y).cast("int"), "fp": negative(y).cast("int")},
        ),
    ).drop("rank", "n_rows")


def tie_block_staircase(df: DataFrame, score: str = "score", y: str = "y", width: float = TIE_WIDTH) -> DataFrame:
    """The staircase at the last score of every block of nearly equal scores.

    Scores belong together if each is within ``width`` of the next one.
    """
    stairs = block_staircase(df, score, y)
    last = F.col("next_score").isNull() | (F.col(score) - F.col("next_score") > F.lit(width))
    return stairs.filter(last).select(score, "cum_n", "cum_tp", "cum_fp", *rates())


def roc_points(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """(fpr, tpr, threshold) at every distinct score, and (0, 0) above all of them."""
    points = block_staircase(df, score, y).select(
        ratio(F.col("cum_fp"), F.col("all_fp")).alias("fpr"),
        ratio(F.col("cum_tp"), F.col("all_tp")).alias("tpr"),
        F.col(score).cast("double").alias("threshold"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    return points.unionByName(origin)


def pr_points(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """(precision, recall, threshold) at every distinct score, and (1, 0) without a threshold."""
    precision, recall, _ = rates()
    points = block_staircase(df, score, y).select(precision, recall, F.col(score).cast("double").alias("threshold"))
    end = df.sparkSession.range(1).select(
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("threshold")
    )
    return points.unionByName(end)


def auc_column() -> Column:
    """Trapezoid area under the ROC staircase; null unless both classes occur.

    The sum runs over integers (as decimals), so its result does not depend on the order of the rows.
    """
    whole = "decimal(19,0)"
    doubled = F.sum(F.col("blk_fp").cast(whole) * (F.col("cum_tp") * 2 - F.col("blk_tp")).cast(whole))
    area = F.max("all_tp").cast("double") * F.max("all_fp").cast("double")
    return F.when(area > 0, doubled.cast("double") / 2.0 / area)


def ap_column() -> Column:
    """Average precision: precision at each step, weighted by the recall gained there."""
    precision = F.col("cum_tp").cast("double") / (F.col("cum_tp") + F.col("cum_fp"))
    total = F.max("all_tp")
    return F.when(total > 0, F.sum(F.when(F.col("blk_tp") > 0, F.col("blk_tp") * precision)) / total)


def curve_summary(df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC and average precision, one row (per group) from one pass over the staircase."""
    return (
        block_staircase(df, score, y, by)
        .groupBy(*by)
        .agg(auc_column().alias("roc_auc"), F.coalesce(ap_column(), F.lit(0.0)).alias("average_precision"))
    )


def roc_auc(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    return block_staircase(df, score, y).agg(auc_column().alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    return block_staircase(df, score, y).agg(ap_column().alias("average_precision"))


def best_f1(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """The threshold with the highest F1; the lowest such threshold if several share it."""
    precision = ratio(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp"))
    recall = ratio(F.col("cum_tp"), F.col("all_tp"))
    points = block_staircase(df, score, y).select(
        F.col(score).cast("double").alias("threshold"), precision.alias("precision"), recall.alias("recall")
    )
    spread = F.col("precision") + F.col("recall")
    f1 = 2 * F.col("precision") * F.col("recall") / F.when(spread == 0, F.lit(1e-12)).otherwise(spread)
    best = points.select("*", f1.alias("f1")).agg(
        F.max(F.struct("f1", (-F.col("threshold")).alias("neg"), "precision", "recall", "threshold")).alias("b")
    )
    return best.filter(F.col("b").isNotNull()).select("b.threshold", "b.f1", "b.precision", "b.recall")


def threshold_metrics(df: DataFrame, thresholds: Sequence[float], score: str = "score", y: str = "y") -> DataFrame:
    """Confusion counts, precision, recall and F1 of ``score >= threshold``, all thresholds in one pass."""
    if not thresholds:
        raise ValueError("no thresholds given")
    aggregates = []
    for i, threshold in enumerate(thresholds):
        alarm = F.coalesce(F.col(score) >= F.lit(float(threshold)), F.lit(False))
        aggregates += [
            F.count_if(alarm & positive(y)).alias(f"tp{i}"),
            F.count_if(alarm & negative(y)).alias(f"fp{i}"),
            F.count_if(~alarm & negative(y)).alias(f"tn{i}"),
            F.count_if(~alarm & positive(y)).alias(f"fn{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"), *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "tn", "fn")]
            )
            for i, t in enumerate(thresholds)
        ]
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        df.agg(*aggregates)
        .select(F.inline(rows))
        .select(
            "threshold",
            ratio(tp, tp + fp).alias("precision"),
            ratio(tp, tp + fn).alias("recall"),
            ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
            "tp",
            "fp",
            "tn",
            "fn",
        )
    )


_PACKED = "iteration int, part int, tp bigint, fp bigint, blocks binary"
_PACKED_ARROW = pa.schema([
    ("iteration", pa.int32()), ("part", pa.int32()), ("tp", pa.int64()), ("fp", pa.int64()), ("blocks", pa.binary()),
])


def _blocks_of(margins: np.ndarray, tp: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct margins, the highest first, with the positives and negatives of each."""
    order = np.argsort(-margins, kind="stable")
    margins = margins[order]
    first = np.flatnonzero(np.append(True, margins[1:] != margins[:-1]))
    return margins[first], np.add.reduceat(tp[order], first), np.add.reduceat(fp[order], first)


def _pack_stages(before: int, cuts: list[np.ndarray]):
    """For each stage and range of margins, the blocks of a part of the rows in one record."""

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        outputs = pa.concat_arrays([c.flatten() for c in table["outputs"].chunks]).to_numpy().reshape(len(table), -1)
        start = table["margin"].to_numpy()
        tp, fp = (table[c].to_numpy() for c in ("tp", "fp"))
        so_far, rows = np.zeros(len(table)), []
        for k in range(outputs.shape[1]):
            so_far = so_far + outputs[:, k]
            margins, hits, misses = _blocks_of(start + so_far, tp, fp)
            parts = np.searchsorted(cuts[k], -margins, "left") if len(cuts) else np.zeros(len(margins), np.int64)
            edges = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
            for begin, end in zip(edges, [*edges[1:], len(margins)]):
                packed = np.stack([margins[begin:end].view(np.int64), hits[begin:end], misses[begin:end]])
                sums = int(hits[begin:end].sum()), int(misses[begin:end].sum())
                rows.append((before + k + 1, int(parts[begin]), *sums, packed.tobytes()))
        columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _PACKED_ARROW, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, schema=_PACKED_ARROW)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                cells += batch.num_rows + len(batch["outputs"].flatten())
            if cells > STAGE_CELLS:
                yield from pack(held)
                held, cells = [], 0
        if held:
            yield from pack(held)

    return run


_SUMS = "iteration int, tp bigint, fp bigint, doubled decimal(38,0), steps double"
_SUMS_ARROW = pa.schema([
    ("iteration", pa.int32()), ("tp", pa.int64()), ("fp", pa.int64()),
    ("doubled", pa.decimal128(38, 0)), ("steps", pa.float64()),
])


def _sum_stage(group: pa.Table) -> pa.Table:
    """What one range adds to the area and to the precision steps of its stage."""
    packed = np.concatenate([np.frombuffer(b.as_py(), np.int64).reshape(3, -1) for b in group["blocks"]], axis=1)
    _, tp, fp = _blocks_of(packed[0].view(np.float64), packed[1], packed[2])
    tp_before, fp_before = (group[c][0].as_py() for c in ("tp_before", "fp_before"))
    cum_tp, cum_fp = np.cumsum(tp), np.cumsum(fp)
    hits, misses = int(cum_tp[-1]), int(cum_fp[-1])
    doubled = int((fp * (cum_tp * 2 - tp)).sum()) + 2 * tp_before * misses
    some = tp > 0
    precision = (cum_tp + tp_before)[some] / (cum_tp + tp_before + cum_fp + fp_before)[some]
    row = (group["iteration"][0].as_py(), hits, misses, Decimal(doubled), float((tp[some] * precision).sum()))
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SUMS_ARROW, strict=True)], schema=_SUMS_ARROW)


def staged_curves(df: DataFrame, before: int, rows: int, y: str = "y") -> DataFrame:
    """``iteration``, ``roc_auc`` and ``average_precision`` after each of the ``outputs`` that are added to ``margin``, one after the other.

    Each task packs the distinct margins of its rows into one record for each stage, so that what is shuffled and
    ordered are records and not rows. Of more than STAGE_ROWS rows, each stage is cut into ranges at sampled margins.
    """
    cuts = _stage_cuts(df, rows) if rows > STAGE_ROWS else []
    counted = [positive(y).cast("bigint").alias("tp"), negative(y).cast("bigint").alias("fp")]
    packed = df.select("margin", "outputs", *counted).mapInArrow(_pack_stages(before, cuts), _PACKED)
    if cuts:
        packed = stored(packed, "blocks")  # the trees are applied once
        totals = packed.groupBy("iteration", "part").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
        earlier = Window.partitionBy("iteration").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        so_far = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("tp", "fp")]
        packed = packed.join(totals.select("iteration", "part", *so_far), ["iteration", "part"])
    else:
        packed = packed.withColumns({"tp_before": F.lit(0).cast("bigint"), "fp_before": F.lit(0).cast("bigint")})
    sums = packed.groupBy("iteration", "part").applyInArrow(_sum_stage, _SUMS).groupBy("iteration")
    tp, fp = F.sum("tp"), F.sum("fp")
    area = tp.cast("double") * fp.cast("double")
    auc = F.when(area > 0, F.sum("doubled").cast("double") / 2.0 / area)
    precision = F.when(tp > 0, F.sum("steps") / tp)
    return sums.agg(auc.alias("roc_auc"), F.coalesce(precision, F.lit(0.0)).alias("average_precision"))


def _stage_cuts(df: DataFrame, rows: int) -> list[np.ndarray]:
    """For each stage, negated margins that cut the rows into ranges of about STAGE_ROWS."""
    ranges = -(-rows // STAGE_ROWS)
    sample = df.sample(min(1.0, STAGE_SAMPLE * ranges / rows), seed=7).select("margin", "outputs").collect()
    margins = np.array([r["margin"] for r in sample])[:, None] + np.cumsum(np.array([r["outputs"] for r in sample]), axis=1)
    shares = np.arange(1, ranges) / ranges
    return [np.unique(np.quantile(-column, shares)) for column in margins.T]
