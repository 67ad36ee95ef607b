"""Plain NumPy answers for small score tables, to compare the distributed operators with."""

import numpy as np
import pandas as pd


def sort_alerts(pdf, score="score"):
    return pdf.sort_values([score, "time", "id"], ascending=[False, True, True], kind="mergesort", na_position="last")


def stairs(pdf, score="score"):
    rows = sort_alerts(pdf, score).reset_index(drop=True)
    tp = (rows["y"] == 1).cumsum().to_numpy()
    fp = (rows["y"] == 0).cumsum().to_numpy()
    return rows, tp, fp


def fpr_points(pdf, percents, score="score", width=None):
    """Last affordable position per budget; with a width only the ends of nearly equal scores are candidates."""
    rows, tp, fp = stairs(pdf, score)
    value = rows[score].to_numpy(dtype=float)
    days = rows["time"].dt.date.nunique()
    candidates = np.arange(len(rows))
    if width is not None:
        last = np.ones(len(rows), dtype=bool)
        last[:-1] = ~(np.abs(value[1:] - value[:-1]) <= width)
        candidates = candidates[last & ~np.isnan(value)]
    result = []
    for percent in percents:
        rate = fp / fp[-1] if fp[-1] else np.zeros(len(fp))
        fits = candidates[rate[candidates] <= percent / 100.0]
        if len(fits) == 0:
            first = rate[candidates[0]] if len(candidates) else rate[0]
            result.append((percent, None, 0.0, 0.0, first, 0, 0.0))
            continue
        at = fits[-1]
        hits = tp[at] + fp[at]
        result.append(
            (
                percent,
                None if np.isnan(value[at]) else value[at],
                tp[at] / hits if hits else 0.0,
                tp[at] / tp[-1] if tp[-1] else 0.0,
                rate[at],
                at + 1,
                (at + 1) / days,
            )
        )
    return result


def topk_points(pdf, percents, score="score"):
    rows, tp, fp = stairs(pdf, score)
    days = rows["time"].dt.date.nunique()
    result = []
    for percent in percents:
        count = int(np.ceil(percent / 100.0 * len(rows)))
        at = count - 1
        hits = tp[at] + fp[at]
        result.append(
            (
                percent,
                rows[score].iloc[at],
                tp[at] / hits if hits else 0.0,
                tp[at] / tp[-1] if tp[-1] else 0.0,
                fp[at] / fp[-1] if fp[-1] else 0.0,
                count,
                count / days,
            )
        )
    return result


def random_scores(seed, n=600, digits=None, nulls=0.0):
    rng = np.random.default_rng(seed)
    score = rng.beta(1, 5, n)
    if digits is not None:
        score = np.round(score, digits)
    y = (rng.random(n) < score).astype(int)
    score = np.where(rng.random(n) < nulls, np.nan, score)
    time = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 10 * 86_400, n), unit="s")
    return pd.DataFrame({"id": rng.permutation(n), "time": time, "y": y, "score": score})


def to_spark(spark, pdf):
    """Spark rows of a score table, several partitions, null instead of NaN."""
    rows = [
        (int(i), t.to_pydatetime(), int(y), None if np.isnan(s) else float(s))
        for i, t, y, s in pdf[["id", "time", "y", "score"]].itertuples(index=False)
    ]
    return spark.createDataFrame(rows, "id bigint, time timestamp_ntz, y int, score double").repartition(5)
