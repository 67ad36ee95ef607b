import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from alertline.functions import lenient_label, lenient_number, lenient_timestamp, strict_timestamp
from alertline.operators import clean, joins, profile, quality, splits
from alertline.plans.fixtures import scored, transactions
from alertline.session import scratch_path
from alertline.sources import sinks, tables

FOLDER = "/root/testdata/sf0.001"


def write_text(spark, name, lines):
    path = scratch_path(spark, name)
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


def test_csv_to_joined_view(spark):
    transaction = write_text(spark, "t", ["TransactionID,Amt,Code", "1,-1,a", "2,2.5,missing", "3,-999,b"])
    identity = write_text(spark, "i", ["TransactionID,Device", "2,phone"])
    store = scratch_path(spark, "store")
    tables.load_csv(spark, "train_transaction", transaction, f"{store}/t")
    tables.load_csv(spark, "train_identity", identity, f"{store}/i", "TransactionID int, Device string")
    tables.create_joined_view(spark, "train_joined", "train_transaction", "train_identity")
    rows = {r["TransactionID"]: r for r in tables.load_joined(spark).collect()}
    assert [rows[i]["Amt"] for i in (1, 2, 3)] == [None, 2.5, None]
    assert [rows[i]["Code"] for i in (1, 2, 3)] == ["a", None, "b"]
    assert [rows[i]["TransactionID_1"] for i in (1, 2, 3)] == [None, 2, None]
    assert tables.load_joined(spark, limit=2).count() == 2
    assert tables.load_joined(spark, limit=0).count() == 3
    # loading again replaces the table
    tables.load_csv(spark, "train_transaction", transaction, f"{store}/t")
    assert spark.table("train_transaction").count() == 3


def test_missing_csv(spark):
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, "/tmp/alertline-no-such-file.csv")


def test_dataset_rules(spark):
    path = scratch_path(spark, "d")
    spark.createDataFrame([("missing", -1.0), ("x", float("nan"))], "a string, b double").write.parquet(path)
    assert [r["a"] for r in tables.load_dataset(spark, path).orderBy(F.desc_nulls_last("a")).collect()] == ["x", None]
    assert tables.load_dataset(spark, path).filter("b is null").count() == 2
    assert tables.load_dataset(spark, path, "text").filter("b is null").count() == 1
    assert tables.load_dataset(spark, path, "none").filter("a = 'missing'").count() == 1


def test_fingerprint_ignores_order(spark):
    data = scored(spark, FOLDER)
    assert tables.fingerprint(data).first() == tables.fingerprint(data.repartition(5, "y").select("y", "score", "id", "time")).first()
    assert tables.fingerprint(data).first() != tables.fingerprint(data.withColumn("y", 1 - F.col("y"))).first()


def test_named_score_table(spark):
    base = sinks.run_path(scratch_path(spark, "runs"), sinks.new_run_id())
    data = scored(spark, FOLDER)
    sinks.write_parquet(data, f"{base}/{tables.RAW_SCORES}.parquet")
    sinks.write_parquet(data.withColumn("p_cal", F.col("score")), f"{base}/{tables.CALIBRATED_SCORES}.parquet")
    assert tables.read_scores(spark, base).columns == ["id", "time", "y", "score"]
    assert tables.read_scores(spark, base, tables.CALIBRATED_SCORES).count() == data.count()
    about = sinks.run_metadata(data, "r", "2024-01-25")
    assert about["rows_val"] == data.count() and about["positives_val"] == data.filter("y = 1").count()
    path = sinks.write_report(spark, about, f"{base}/meta")
    assert sinks.read_report(spark, path) == about


def test_sparse_limit_is_strict(spark):
    data = spark.range(100).select(
        F.when(F.col("id") < 10, 1).alias("exactly"), F.when(F.col("id") < 9, 1).alias("above"), "id"
    )
    assert clean.sparse_columns(data) == ["above"]
    assert clean.drop_sparse(data).columns == ["exactly", "id"]
    assert clean.missing_rates(data.filter("id < 0")) == {}


def test_feature_lists(spark):
    report = clean.feature_report(
        clean.add_time_features(transactions(spark, FOLDER)).withColumn("flag", F.lit(True)).drop("ts")
    )
    assert report.dropped == ["TransactionDT", "TransactionID", "day", "dt", "hour", "isFraud", "weekday"]
    assert report.not_found == ["TransactionID_1"]
    assert report.numeric == ["C1", "TransactionAmt", "flag", "sparse90", "sparse95"]
    assert report.categorical == ["DeviceInfo", "ProductCD"]
    assert report.row()["n_features_total"] == 7


def test_contract(spark):
    data = transactions(spark, FOLDER)
    assert clean.select_contract(data, ["C1", "ProductCD"], ["ts"]).columns == ["ts", "C1", "ProductCD"]
    with pytest.raises(ValueError, match="V1"):
        clean.select_contract(data, ["C1", "V1"])


def test_casts(spark):
    raw = spark.createDataFrame([("1", "2024-01-02 03:04:05"), ("x", "never"), (None, None), ("NaN", ""), ("1.9", "2024-01-02")], "n string, t string")
    rows = raw.select(lenient_label(F.col("n")).alias("y"), lenient_number(F.col("n")).alias("s"), lenient_timestamp(F.col("t")).alias("t")).collect()
    assert [r["y"] for r in rows] == [1, 0, 0, 0, 1]
    assert [r["s"] for r in rows] == [1.0, None, None, None, 1.9]
    assert [r["t"] is None for r in rows] == [False, True, True, True, False]
    with pytest.raises(PySparkException):
        raw.select(strict_timestamp(F.col("t"))).collect()


def test_time_features_of_missing_seconds(spark):
    data = spark.createDataFrame([(None,), (0,), (86_399,), (86_400,)], "TransactionDT bigint")
    rows = clean.add_time_features(data).collect()
    assert [str(r["dt"]) for r in rows[:2]] == ["2017-01-01 00:00:00"] * 2
    assert [(r["hour"], r["day"], r["weekday"]) for r in rows] == [(0, 0, 6), (0, 0, 6), (23, 0, 6), (0, 1, 0)]


def test_join_is_planned_without_a_forced_broadcast(spark):
    left = spark.range(10).withColumnRenamed("id", "k")
    assert joins.joined_view(left, left.filter("k < 3"), "k").columns == ["k", "k_1"]
    assert tuple(joins.join_coverage(left, left.filter("k < 3"), "k").first()) == (3, 10)


def test_balance_of_unlabelled_rows(spark):
    data = spark.createDataFrame([(1,), (0,), (None,), (None,)], "isFraud int")
    assert tuple(profile.class_balance(data).first()) == (4, 1, 3, 0.25)
    assert profile.fraud_stats(data).first()["fraud_rate"] == 0.5
    assert profile.prevalence(data).first()[0] == 0.25
    empty = data.filter("isFraud > 5")
    assert profile.prevalence(empty).first()[0] != profile.prevalence(empty).first()[0]  # NaN


def test_histogram_of_one_value(spark):
    data = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    bins = profile.histogram(data, "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in bins] == [0, 0, 2, 0]
    assert (bins[0]["left_edge"], bins[-1]["right_edge"]) == (1.5, 2.5)


def test_fold_summary_uses_the_population_deviation(spark):
    """Published folds: ROC-AUC 0.9305 +- 0.0068, PR-AUC 0.6080 +- 0.0430."""
    folds = spark.createDataFrame(
        [
            (0.9260918991234225, 0.6103483428931195),
            (0.940193206957799, 0.6595112079858458),
            (0.9253442208131041, 0.5542476916856084),
        ],
        "roc_auc double, pr_auc double",
    )
    row = profile.fold_summary(folds).first()
    assert [round(row[c], 4) for c in ("mean_roc_auc", "std_roc_auc", "mean_pr_auc", "std_pr_auc")] == [0.9305, 0.0068, 0.608, 0.043]


def test_failed_checks(spark):
    data = scored(spark, FOLDER)
    quality.enforce(quality.score_checks(data))
    broken = {
        "id_unique": data.union(data.filter("id = 1")),
        "score_finite": data.withColumn("score", F.when(F.col("id") == 1, float("inf")).otherwise(F.col("score"))),
        "time_not_null": data.withColumn("time", F.when(F.col("id") > 1, F.col("time"))),
        "negatives": data.filter("y = 1"),
        "rows": data.filter("id < 0"),
    }
    for name, table in broken.items():
        with pytest.raises(quality.QualityError, match=name):
            quality.enforce(quality.score_checks(table))
    with pytest.raises(quality.QualityError):
        quality.score_checks(data.drop("time"))
    empty_side = splits.split_report(data, 0, "time", "y")
    with pytest.raises(quality.QualityError, match="train_rows"):
        quality.enforce(quality.split_checks(empty_side))


def test_positional_split_breaks_ties_by_id(spark):
    data = spark.createDataFrame(
        [(i, "2024-01-01 00:00:00") for i in range(10)], "id bigint, time string"
    ).withColumn("time", F.col("time").cast("timestamp_ntz"))
    split = splits.positional_split(data)
    assert sorted(r["id"] for r in split.head.collect()) == list(range(8))
    assert sorted(r["id"] for r in split.tail.collect()) == [8, 9]
    assert splits.positional_split(data.filter("id < 0")).head.isEmpty()


def test_upsert_replaces_only_its_key(spark):
    row = ("r1", "isotonic", "full", "topk", "K_percent", 1.0, 0.5, 0.1, 0.2, 0.3, 10, 1.0)
    schema = "run_id string, calibrator string, window string, mode string, budget_type string, budget_value double, threshold_prob double, precision double, recall double, fpr double, alerts bigint, alerts_per_day double"
    path = scratch_path(spark, "points")

    def put(*rows):
        sinks.upsert_points(spark.createDataFrame(list(rows), schema), path)

    put(row, ("r2", *row[1:]))
    put(("r1", "isotonic", "full", "fpr", *row[4:]), ("r1", "platt", *row[2:]))
    stored = {(r["run_id"], r["calibrator"], r["mode"]) for r in sinks.read_points(spark, path).collect()}
    assert stored == {("r1", "isotonic", "fpr"), ("r1", "platt", "topk"), ("r2", "isotonic", "topk")}


def test_cut_filters_reach_the_scan(spark):
    data = spark.read.parquet(f"{FOLDER}/events.parquet").select("event_id", "ts")
    plan = clean.time_between(data, "ts", after="2024-01-10", upto="2024-01-20")._jdf.queryExecution().executedPlan().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThan(ts" in pushed and "LessThanOrEqual(ts" in pushed
