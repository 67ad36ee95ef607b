import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from alertline.operators import order
from alertline.operators.order import Ladder, alert_order, asc, desc, not_after, rank_rows, rows_at, running
from alertline.plans.fixtures import scored

FOLDER = "/root/testdata/sf0.01"


def variants(spark):
    data = scored(spark, FOLDER)
    moment = F.to_timestamp_ntz(F.lit("2024-01-03 00:00:00"))
    third = F.col("id") % 3 > 0
    return {
        "distinct": data,
        "rounded": data.withColumn("score", F.round("score", 2)),
        "one score": data.withColumn("score", F.lit(0.5)),
        "hot score and hot time": data.withColumn("score", F.when(third, 0.5).otherwise(F.col("score"))).withColumn(
            "time", F.when(F.col("id") % 6 < 3, moment).otherwise(F.col("time"))
        ),
        "many nulls": data.withColumn("score", F.when(third, F.col("score"))),
        "null times": data.withColumn("score", F.round("score", 1)).withColumn("time", F.when(third, F.col("time"))),
        "signed zeros": data.withColumn("score", F.when(third, F.lit(0.0)).otherwise(F.lit(-0.0))),
        "empty": data.filter("id < 0"),
        "one row": data.filter("id = 7"),
    }


NAMES = ("distinct", "rounded", "one score", "hot score and hot time", "many nulls", "null times", "signed zeros", "empty", "one row")


@pytest.mark.parametrize("name", NAMES)
def test_running_equals_one_window(spark, name):
    data = variants(spark)[name]
    along = Window.orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("time"), F.asc_nulls_last("id"))
    expected = data.select(
        "id",
        F.row_number().over(along).cast("bigint").alias("rank"),
        F.sum(F.col("y").cast("bigint")).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_tp"),
        F.sum(F.col("y").cast("bigint")).over(Window.partitionBy()).alias("all_tp"),
    )
    got = running(data, alert_order(), {"tp": F.col("y")}).select(expected.columns)
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()


@pytest.mark.parametrize("name", [n for n in NAMES if n != "empty"])
def test_positions_and_predicates(spark, name):
    data = variants(spark)[name]
    n = data.count()
    wanted = sorted({1, max(1, n // 3), max(1, n // 2), n})
    ranked = {r["rank"]: r["id"] for r in rank_rows(data, alert_order()).filter(F.col("rank").isin(wanted)).collect()}
    found = rows_at(data, alert_order(), [0, *wanted, n + 1])
    assert {p: v[2] for p, v in found.items()} == ranked
    for p, row in found.items():
        assert data.filter(not_after(data, alert_order(), row)).count() == p
        assert data.filter(not_after(data, alert_order(), row, strict=True)).count() == p - 1


def test_counter_positions(spark):
    data = scored(spark, FOLDER)
    ladder = Ladder(data, alert_order(), {"positive": F.col("y") == 1})
    total = ladder.total("positive")
    assert (ladder.total(), total) == (10_000, 884)
    found = ladder.find(positive=[1, 100, total, total + 1], row=[1])
    along = Window.orderBy(F.desc("score"), "time", "id")
    expected = data.filter("y = 1").withColumn("n", F.row_number().over(along))
    for p in (1, 100, total):
        assert found[("positive", p)][2] == expected.filter(F.col("n") == p).first()["id"]
    assert ("positive", total + 1) not in found


def test_frequent_values_are_split(spark):
    """A score of a third of all rows is cut along the time, and inside a frequent time along the id."""
    data = variants(spark)["hot score and hot time"]
    ranges = order.find_ranges(data, alert_order())
    assert len(ranges.splits) == 3
    biggest = ranges.assign(data).groupBy(*ranges.columns).count().agg(F.max("count")).first()[0]
    assert biggest < 10_000 * 6 / order.range_count(spark)


def test_many_nulls_are_split(spark):
    data = variants(spark)["many nulls"]
    ranges = order.find_ranges(data, alert_order())
    biggest = ranges.assign(data).groupBy(*ranges.columns).count().agg(F.max("count")).first()[0]
    assert biggest < 10_000 * 6 / order.range_count(spark)


def test_result_does_not_depend_on_partitions(spark):
    data = scored(spark, FOLDER)
    first = rank_rows(data, alert_order()).select("id", "rank")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        second = rank_rows(data.repartition(7, "y"), alert_order()).select("id", "rank")
        assert first.exceptAll(second).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_groups_keep_their_own_order(spark):
    data = scored(spark, FOLDER)
    got = running(data, [desc("score"), asc("id")], by=["y"]).select("id", "rank", "n_rows")
    along = Window.partitionBy("y").orderBy(F.desc("score"), "id")
    expected = data.select(
        "id",
        F.row_number().over(along).cast("bigint").alias("rank"),
        F.count(F.lit(1)).over(Window.partitionBy("y")).alias("n_rows"),
    )
    assert got.exceptAll(expected).isEmpty()


def test_neighbours_cross_ranges(spark):
    data = spark.range(500).select((F.col("id") * 0.5).alias("score"))
    got = running(data, [asc("score")], lag={"before": "score"}, lead={"after": "score"})
    wrong = got.filter(
        ~F.col("before").eqNullSafe(F.when(F.col("score") > 0, F.col("score") - 0.5))
        | ~F.col("after").eqNullSafe(F.when(F.col("score") < 249.5, F.col("score") + 0.5))
    )
    assert wrong.isEmpty()


def test_no_row_reaches_a_single_task(spark):
    """Only per-range totals may meet in one partition."""
    plan = rank_rows(scored(spark, FOLDER), alert_order())._jdf.queryExecution().executedPlan().toString()
    for line, below in zip(plan.splitlines(), plan.splitlines()[1:]):
        if "SinglePartition" in line:
            assert "HashAggregate" in below and "_range0" in below


def test_numbers_beyond_exact_doubles(spark):
    """2 ** 53 and 2 ** 53 + 1 are one double, but not one key."""
    df = spark.range(1000).select((F.col("id") % 2 + 2**53).alias("a"), (-F.col("id")).alias("b"))
    got = [(r["a"], r["b"]) for r in rank_rows(df, [asc("a"), asc("b")]).orderBy("rank").collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("scores", [100, 500])
def test_cells_stay_near_the_wanted_number(spark, scores):
    """Each frequent score is cut by its own share of the ranges, not by the cuts of all others."""
    df = spark.range(200_000).select(
        (F.xxhash64("id") % scores).cast("double").alias("score"),
        F.timestamp_micros(F.col("id") * 1000).cast("timestamp_ntz").alias("time"),
        "id",
    )
    keys = alert_order()
    ranges = order.find_ranges(df, keys, 2048)
    cells = ranges.assign(df).groupBy(*ranges.columns).count()
    assert cells.count() <= 3 * 2048
    largest = cells.agg(F.max("count")).first()[0]
    assert largest <= max(6 * 200_000 / 2048, 3 * 200_000 / scores / max(1, 2048 // scores // 2))
    ranked = rank_rows(df, keys)
    along = Window.orderBy(F.desc("score"), "time", "id")
    wrong = ranked.withColumn("expected", F.row_number().over(along)).filter("rank != expected")
    assert wrong.count() == 0


def test_ranges_follow_measured_rows(spark, monkeypatch):
    monkeypatch.setattr(order, "ROWS_PER_RANGE", 100)
    df = spark.range(50_000).select(F.col("id").cast("double").alias("score"))
    ranges = order.find_ranges(df, [asc("score")])
    assert 400 <= len(ranges.splits[0]) <= 600
