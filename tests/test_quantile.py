import numpy as np
import pytest
from pyspark.sql import functions as F

from alertline.operators import quantile
from alertline.operators.quantile import exact_quantiles
from alertline.operators.splits import time_cut

SHARES = (0.0, 0.1, 0.25, 0.5, 0.8, 0.999, 1.0)


@pytest.fixture
def table(spark):
    rng = np.random.default_rng(5)
    n = 5_000
    columns = {
        "normal": rng.normal(size=n),
        "skewed": np.exp(rng.normal(size=n) * 3),
        "hot": np.where(rng.random(n) < 0.4, 1.0, rng.random(n) * 2),
        "two": (rng.random(n) < 0.5).astype(float),
        "gaps": np.where(rng.random(n) < 0.9, np.nan, rng.random(n)),
    }
    rows = [tuple(float(v) for v in r) for r in zip(*columns.values())]
    return columns, spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(6)


@pytest.mark.parametrize("small", [10**6, 200])
def test_equals_numpy(table, small):
    """With a low limit the columns are narrowed by sketches first."""
    columns, df = table
    got = exact_quantiles(df, {c: SHARES for c in columns}, small)
    for name, values in columns.items():
        assert np.allclose(got[name], np.quantile(values[~np.isnan(values)], SHARES), rtol=1e-14, atol=0), name


@pytest.fixture
def passes(monkeypatch):
    """The bracket sizes after each narrowing pass."""
    seen, narrow = [], quantile._narrow

    def counted(data, brackets):
        narrow(data, brackets)
        seen.append([b.size for b in brackets])

    monkeypatch.setattr(quantile, "_narrow", counted)
    return seen


def test_sorted_partitions_take_few_passes(spark, passes):
    df = spark.range(0, 400_000, 1, 8).select((F.col("id") * 7).alias("v"))
    assert exact_quantiles(df, {"v": (0.25, 0.5)}, 1000)["v"] == [699_998.25, 1_399_996.5]
    assert len(passes) <= 3


def test_one_large_and_many_small_partitions(spark, passes):
    large = spark.range(0, 190_000, 1, 1).select(F.col("id").alias("v"))
    small = spark.range(190_000, 200_000, 1, 7).select(F.col("id").alias("v"))
    assert exact_quantiles(large.union(small), {"v": (0.5,)}, 1000)["v"] == [99_999.5]
    assert max(passes[-1]) <= 1000


def test_frequent_neighbours_end(spark):
    df = spark.range(10_000).select((F.col("id") % 2).cast("double").alias("v"))
    assert exact_quantiles(df, {"v": (0.5,)}, 100)["v"] == [0.5]


def test_columns_keep_their_types(spark):
    big = 9_007_199_254_740_993
    df = spark.range(3001).select(F.lit(big).alias("whole"), F.col("id").cast("double").alias("real"))
    for small in (10**6, 100):
        assert exact_quantiles(df, {"whole": (0.5,), "real": (0.5,)}, small) == {"whole": [big], "real": [1500.0]}


def test_whole_numbers_stay_exact(spark):
    big = 1_704_067_200_000_000
    df = spark.range(5).select((F.col("id") * 3 + big).alias("v"))
    assert exact_quantiles(df, {"v": (0.5,)})["v"] == [big + 6]


def test_without_values(spark):
    df = spark.range(3).select(F.lit(None).cast("double").alias("v"))
    assert exact_quantiles(df, {"v": (0.5,)}) == {"v": [None]}


def test_published_time_cut(spark):
    """Position 0.8 (590540 - 1) = 472431.2 between 02:54:02 and 02:55:00 is 02:54:13.6."""
    early, late = "2017-05-22 02:54:02", "2017-05-22 02:55:00"
    rows = spark.range(590_540).select(
        F.when(F.col("id") <= 472_431, F.lit(early)).otherwise(F.lit(late)).cast("timestamp_ntz").alias("dt")
    )
    assert time_cut(rows) == 1_495_421_653_600_000
