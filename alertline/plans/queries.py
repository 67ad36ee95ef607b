"""One named query per operator, each over whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertline.functions.scalar import epoch_micros, lenient_label, lenient_number, lenient_timestamp, strict_timestamp
from alertline.operators import boost, calibration, clean, curves, joins, points, prep, profile, quality, splits
from alertline.operators.order import alert_order, asc, desc, ordered, rank_rows
from alertline.operators.quantile import exact_quantiles
from alertline.plans import decisions
from alertline.plans.fixtures import heavy_ties, scored, table, transactions
from alertline.session import scratch_path, stored
from alertline.sources import sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NUMERIC = ["C1", "TransactionAmt", "sparse90"]
CATEGORICAL = ["DeviceInfo", "ProductCD"]
CV_CUTS = ("2024-01-10", "2024-01-17", "2024-01-24", "2024-01-31")
# Trained models and folds by the content of the table, as several queries of a session ask for the same training.
_MODELS: dict[tuple, boost.TrainedModel] = {}
_FOLDS: dict[tuple, DataFrame] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Ratios to nine digits and timestamps as epoch micros, the form in which results are compared."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if field.name in names:
            column = F.round(column.cast("double"), 9)
        elif field.dataType.typeName().startswith("timestamp"):
            column = epoch_micros(column)
        elif field.dataType.typeName() in ("integer", "boolean"):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


_RATES = ("precision", "recall", "fpr")
_POINT = (*_RATES, "threshold", "alerts_per_day")


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    data = clean.clean(transactions(spark, folder))
    return splits.time_split(data, splits.time_cut(data, "ts"), "ts")


# Sources and sinks


@query
def row_count_audit(spark, folder):
    return tables.row_counts({n: table(spark, folder, n) for n in ("region", "nation", "orders", "events")})


@query
def fingerprint(spark, folder):
    return tables.fingerprint(table(spark, folder, "events"))


@query
def limit_scan(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return rounded(tables.limited(ordered(orders, [desc("o_totalprice"), asc("o_orderkey")]), 100))


@query
def csv_roundtrip(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    path = scratch_path(spark, "csv")
    sinks.write_csv(events, f"{path}/csv")
    return rounded(tables.load_csv(spark, "events_from_csv", f"{path}/csv", f"{path}/table", events.schema), "value")


@query
def named_scores(spark, folder):
    """Both score tables of a run, written and read by name."""
    data = scored(spark, folder)
    run = sinks.run_path(scratch_path(spark, "run"), "named")
    sinks.write_parquet(data, f"{run}/{tables.RAW_SCORES}.parquet")
    squared = data.withColumn("p_cal", F.col("score") * F.col("score"))
    sinks.write_parquet(squared, f"{run}/{tables.CALIBRATED_SCORES}.parquet")
    raw = tables.read_scores(spark, run).withColumn("p_cal", F.lit(None).cast("double"))
    both = [raw, tables.read_scores(spark, run, tables.CALIBRATED_SCORES)]
    named = [t.withColumn("dataset", F.lit(n)) for t, n in zip(both, (tables.RAW_SCORES, tables.CALIBRATED_SCORES))]
    return rounded(named[0].unionByName(named[1]), "score", "p_cal")


# Joins


@query
def join_coverage(spark, folder):
    return joins.join_coverage(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")


@query
def joined_view(spark, folder):
    return rounded(joins.joined_view(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id"))


# Cleaning and profiles


@query
def clean_sentinels(spark, folder):
    return rounded(clean.clean(transactions(spark, folder)))


@query
def sparse_drop(spark, folder):
    return rounded(clean.drop_sparse(clean.clean(transactions(spark, folder))))


@query
def missing_profile_topn(spark, folder):
    return rounded(profile.missing_profile(clean.clean(transactions(spark, folder)), 5), "missing_rate")


@query
def time_features(spark, folder):
    gaps = transactions(spark, folder).withColumn(
        "TransactionDT", F.when(F.col("TransactionID") % 50 != 0, F.col("TransactionDT"))
    )
    return rounded(clean.add_time_features(gaps.select("TransactionID", "TransactionDT")))


@query
def lenient_casts(spark, folder):
    raw = transactions(spark, folder).select(
        "TransactionID",
        F.when(F.col("TransactionID") % 7 == 0, F.lit("bad")).otherwise(F.col("ts").cast("string")).alias("time_text"),
        F.when(F.col("TransactionID") % 11 == 0, F.lit("n/a")).otherwise(F.col("isFraud").cast("string")).alias("y_text"),
        F.when(F.col("TransactionID") % 3 == 0, F.lit("x")).otherwise(F.col("C1").cast("string")).alias("score_text"),
        F.col("ts").cast("string").alias("good_time"),
    )
    return rounded(
        raw.select(
            "TransactionID",
            lenient_timestamp(F.col("time_text")).alias("time"),
            lenient_label(F.col("y_text")).alias("y"),
            lenient_number(F.col("score_text")).alias("score"),
            strict_timestamp(F.col("good_time")).alias("strict_time"),
        )
    )


@query
def filters(spark, folder):
    data = clean.clean(transactions(spark, folder))
    window = clean.time_between(data, "ts", after="2024-01-10", upto="2024-01-20")
    kept, _ = clean.present(window, "TransactionAmt", "ts")
    return rounded(
        clean.to_score_schema(kept, "TransactionID", "ts", "isFraud", "TransactionAmt").withColumn(
            "y_hat", clean.predicted("score", 40.0)
        )
    )


@query
def fraud_stats(spark, folder):
    labelled = joins.joined_view(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"), "doc_id")
    both = profile.fraud_stats(scored(spark, folder), "y").withColumn("source", F.lit("events"))
    return rounded(
        both.unionByName(profile.fraud_stats(labelled, "quality").withColumn("source", F.lit("labels"))), "fraud_rate"
    )


@query
def class_balance(spark, folder):
    labelled = joins.joined_view(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"), "doc_id")
    both = profile.class_balance(scored(spark, folder), "y").withColumn("source", F.lit("events"))
    return rounded(
        both.unionByName(profile.class_balance(labelled, "quality").withColumn("source", F.lit("labels"))), "prevalence"
    )


@query
def rate_by_hour(spark, folder):
    return rounded(profile.mean_by(clean.add_time_features(transactions(spark, folder)), "hour"), "fraud_rate")


@query
def rate_by_weekday(spark, folder):
    return rounded(profile.mean_by(clean.add_time_features(transactions(spark, folder)), "weekday"), "fraud_rate")


@query
def describe_time(spark, folder):
    features = clean.add_time_features(transactions(spark, folder))
    return rounded(
        profile.describe(features, ["hour", "day", "weekday"]), "mean", "std", "min", "q25", "q50", "q75", "max"
    )


@query
def amount_histogram(spark, folder):
    amounts = table(spark, folder, "events").select(F.log1p("value").alias("amount"))
    return rounded(profile.histogram(amounts, "amount", 80), "left_edge", "right_edge")


@query
def unique_days(spark, folder):
    return rounded(profile.unique_days(scored(spark, folder)))


# Splits and checks


@query
def time_quantile_cut(spark, folder):
    data = scored(spark, folder)
    return spark.createDataFrame([(splits.time_cut(data, "time"),)], "t_cut bigint")


@query
def split_report(spark, folder):
    data = scored(spark, folder)
    return rounded(splits.split_report(data, splits.time_cut(data, "time"), "time", "y"), "prevalence")


@query
def positional_split(spark, folder):
    split = splits.positional_split(scored(spark, folder))
    return rounded(
        split.head.withColumn("side", F.lit("head")).unionByName(split.tail.withColumn("side", F.lit("tail"))), "score"
    )


@query
def dup_keys(spark, folder):
    return rounded(quality.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query
def quality_suite(spark, folder):
    data = transactions(spark, folder)
    table_part = quality.table_checks(data, "isFraud", "ts")
    return rounded(quality.score_checks(scored(spark, folder)).unionByName(table_part), "observed")


@query
def split_checks(spark, folder):
    data = scored(spark, folder)
    return rounded(
        quality.split_checks(splits.split_report(data, splits.time_cut(data, "time"), "time", "y")), "observed"
    )


@query
def monotone_check(spark, folder):
    data = scored(spark, folder).select(
        "score",
        F.round("score", 3).alias("stepped"),
        (F.col("score") + F.col("y") * 0.01).alias("shifted"),
    )
    stepped = quality.monotone_drops(data, "stepped").withColumn("p", F.lit("stepped"))
    return rounded(stepped.unionByName(quality.monotone_drops(data, "shifted").withColumn("p", F.lit("shifted"))))


# Order and curves


@query
def det_rank(spark, folder):
    return rounded(rank_rows(scored(spark, folder), alert_order()).select("id", "rank"))


@query
def row_index_by_time(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    ranked = rank_rows(orders, [asc("o_orderdate"), asc("o_orderkey")])
    return rounded(ranked.select("o_orderkey", "o_orderdate", (F.col("rank") - 1).alias("row_index")))


@query
def staircase_rows(spark, folder):
    return rounded(curves.row_staircase(scored(spark, folder)).drop("time", "score", "y"), *_RATES)


@query
def staircase_blocks(spark, folder):
    data = scored(spark, folder).withColumn("score", F.round("score", 4))
    return rounded(curves.tie_block_staircase(data), "score", *_RATES)


@query
def roc_points(spark, folder):
    curve = curves.roc_points(scored(spark, folder))
    finite = F.when(F.col("threshold") < float("inf"), F.col("threshold"))
    return rounded(curve.withColumn("threshold", finite), "fpr", "tpr", "threshold")


@query
def pr_points(spark, folder):
    return rounded(curves.pr_points(scored(spark, folder)), "precision", "recall", "threshold")


@query
def roc_auc(spark, folder):
    return rounded(curves.roc_auc(scored(spark, folder)), "roc_auc")


@query
def avg_precision(spark, folder):
    return rounded(curves.average_precision(scored(spark, folder)), "average_precision")


@query
def tied_curve_summary(spark, folder):
    return rounded(curves.curve_summary(heavy_ties(spark, folder)), "roc_auc", "average_precision")


@query
def best_f1(spark, folder):
    return rounded(curves.best_f1(scored(spark, folder)), "threshold", "f1", "precision", "recall")


@query
def thr_metrics(spark, folder):
    return rounded(
        curves.threshold_metrics(scored(spark, folder), [0.25, 0.5, 0.75, 0.99]), "threshold", "precision", "recall", "f1"
    )


# Operating points


@query
def topk_table(spark, folder):
    return rounded(points.topk_table(scored(spark, folder)), "K_or_FPR", *_POINT)


@query
def topk_duplicates(spark, folder):
    """Order lines without their day: many rows are equal in score, time and id."""
    ties = heavy_ties(spark, folder).withColumn("time", F.to_timestamp_ntz(F.lit("1995-01-01 00:00:00")))
    return rounded(points.topk_table(ties.withColumn("id", F.floor(F.col("id") / 1000))), "K_or_FPR", *_POINT)


@query
def topk_missing_scores(spark, folder):
    """Some scores are null, some NaN; both are missing and come last."""
    gaps = F.when(F.col("id") % 3 == 1, F.lit(float("nan"))).when(F.col("id") % 3 == 2, F.col("score"))
    data = scored(spark, folder).withColumn("score", gaps)
    return rounded(points.topk_table(data, (5.0, 30.0, 100.0)), "K_or_FPR", *_POINT)


@query
def narrowed_quantiles(spark, folder):
    """Quantiles by the way that long columns take, with a low limit for the rows that are ordered."""
    data = scored(spark, folder).select("id", "score", F.round("score", 1).alias("tied"))
    shares = (0.1, 0.25, 0.5, 0.8, 0.99)
    found = exact_quantiles(data, {c: shares for c in data.columns}, small_bracket=500)
    rows = [(c, q, float(v)) for c, values in found.items() for q, v in zip(shares, values)]
    return rounded(spark.createDataFrame(rows, "column string, share double, value double"), "share", "value")


@query
def prevalence(spark, folder):
    return rounded(profile.prevalence(transactions(spark, folder)), "prevalence")


@query
def probability_suite(spark, folder):
    data = scored(spark, folder).withColumn("p_cal", F.when(F.col("id") % 1000 == 7, 1.5).otherwise(F.col("score") / 2))
    return rounded(quality.probability_checks(data), "observed")


@query
def stored_transactions(spark, folder):
    """Written and scanned again with the rule that only the sentinel text is missing."""
    path = sinks.write_parquet(transactions(spark, folder), scratch_path(spark, "transactions"))
    return rounded(tables.load_dataset(spark, path, "text"))


@query
def joined_scan(spark, folder):
    """A named view of transactions and their labels, scanned with every encoding of a gap as null."""
    transactions(spark, folder).createOrReplaceTempView("scan_transaction")
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "TransactionID")
    labels.createOrReplaceTempView("scan_identity")
    tables.create_joined_view(spark, "scan_joined", "scan_transaction", "scan_identity")
    return rounded(tables.load_joined(spark, "scan_joined"))


@query
def feature_kinds(spark, folder):
    """The features of the transactions by kind; numeric ones with their number of values."""
    data = clean.clean(transactions(spark, folder))
    report = clean.feature_report(data, ("TransactionID", "isFraud", "ts", "absent"))
    kinds = {"dropped": report.dropped, "numeric": report.numeric, "categorical": report.categorical}
    counts = data.agg(*[F.count(c).alias(c) for c in data.columns]).first()
    rows = [(kind, c, counts[c]) for kind, names in kinds.items() for c in names]
    return spark.createDataFrame(rows, "kind string, name string, n_values bigint")


@query
def contracted_projection(spark, folder):
    data = clean.clean(transactions(spark, folder))
    return rounded(clean.select_contract(data, ["DeviceInfo", "C1"], ["TransactionID"]))


@query
def run_metadata(spark, folder):
    """Metadata of a score table, written as a report and read again, one row for each value."""
    about = sinks.run_metadata(scored(spark, folder), "r1", "2024-01-25 00:00:00", "time")
    path = sinks.write_report(spark, about, scratch_path(spark, "report"))
    kept = ("run_id", "score_type", "time_column", "t_cut", "rows_val", "positives_val")
    read = sinks.read_report(spark, path)
    return spark.createDataFrame([(k, str(read[k])) for k in kept], "name string, value string")


@query
def topk_selection(spark, folder):
    data = scored(spark, folder).withColumn("score", F.round("score", 2))
    return rounded(points.flag_topk(data, 2.0).select("id", "selected"))


@query
def precision_at_k_floor(spark, folder):
    return rounded(points.precision_at_k(scored(spark, folder)), "share", "precision")


@query
def topk_precision_by_score(spark, folder):
    data = scored(spark, folder).withColumn("rounded", F.round("score", 2))
    return rounded(points.topk_precisions(data, ["score", "rounded"]), "K", "precision")


@query
def recall_at_fpr_curve(spark, folder):
    return rounded(points.recall_at_fpr(scored(spark, folder)), "target_fpr", "recall")


@query
def fpr_rows(spark, folder):
    return rounded(points.fpr_rows(scored(spark, folder)), "K_or_FPR", *_POINT)


@query
def fpr_blocks(spark, folder):
    data = scored(spark, folder).withColumn("score", F.round("score", 3))
    return rounded(points.fpr_blocks(data), "K_or_FPR", *_POINT)


@query
def tied_fpr_blocks(spark, folder):
    return rounded(points.fpr_blocks(heavy_ties(spark, folder), (5.0, 10.0, 20.0, 50.0)), "K_or_FPR", *_POINT)


def _points(spark, folder, run_id="run_a", digits=2):
    data = scored(spark, folder).withColumn("p_cal", F.round("score", digits))
    return points.operating_points(data, run_id, "isotonic")


_POINT_RATIOS = ("budget_value", "threshold_prob", *_RATES, "alerts_per_day")


@query
def operating_points(spark, folder):
    return rounded(_points(spark, folder), *_POINT_RATIOS)


@query
def op_upsert(spark, folder):
    path = scratch_path(spark, "points")
    sinks.upsert_points(_points(spark, folder, "run_a", 1), path)
    sinks.upsert_points(_points(spark, folder, "run_b", 2), path)
    sinks.upsert_points(_points(spark, folder, "run_a", 2), path)
    return rounded(sinks.read_points(spark, path), *_POINT_RATIOS)


@query
def monotone_badges(spark, folder):
    return rounded(quality.monotone_badges(_points(spark, folder)))


# Calibration


@query
def brier(spark, folder):
    data = scored(spark, folder).withColumn("rounded", F.round("score", 1))
    return rounded(calibration.brier(data, ["score", "rounded"]), "brier")


@query
def ece_uniform(spark, folder):
    return rounded(calibration.ece(scored(spark, folder), "score"), "ece")


@query
def ece_quantile(spark, folder):
    return rounded(calibration.ece(scored(spark, folder), "score", strategy="quantile"), "ece")


@query
def reliability_quantile(spark, folder):
    return rounded(calibration.reliability(scored(spark, folder), "score", strategy="quantile"), "p_mean", "y_mean")


@query
def reliability_uniform(spark, folder):
    data = scored(spark, folder).withColumn("squared", F.col("score") * F.col("score"))
    return rounded(calibration.reliability_by_score(data, ["score", "squared"]), "p_mean", "y_mean")


@query
def isotonic_probs(spark, folder):
    data = scored(spark, folder)
    fitted = calibration.fit_isotonic(data)
    return rounded(fitted.transform(data.select("score").distinct()), "score", "p_cal")


@query
def platt_probs(spark, folder):
    data = scored(spark, folder)
    fitted = calibration.fit_platt(data).transform(data)
    return rounded(fitted.withColumn("p_cal", F.round("p_cal", 6)), "score")


@query
def holdout_metrics(spark, folder):
    hold = splits.positional_split(scored(spark, folder)).tail
    return rounded(
        calibration.metrics_table(spark, list(calibration.calibration_metrics(hold, ["score"]).values())),
        "brier", "ece", "top_0_5", "top_1_0", "top_2_0", "top_5_0",
    )


@query
def calibration_report(spark, folder):
    fitted = decisions.calibrate(scored(spark, folder))
    return calibration.metrics_table(spark, list(fitted.metrics.values()))


@query
def calibrator_choice(spark, folder):
    fitted = decisions.calibrate(scored(spark, folder))
    return spark.createDataFrame(
        [(fitted.chosen.kind, fitted.fitted_on["n_train"], fitted.fitted_on["n_holdout"])],
        "calibrator string, n_train bigint, n_holdout bigint",
    )


# Preparation and model


@query
def median_impute(spark, folder):
    train, val = _sides(spark, folder)
    fitted = prep.fit_prep(train, NUMERIC, [])
    return rounded(fitted.impute(val).select("TransactionID", *NUMERIC), *NUMERIC)


@query
def mode_impute(spark, folder):
    train, val = _sides(spark, folder)
    fitted = prep.fit_prep(train, [], CATEGORICAL)
    return rounded(fitted.impute(val).select("TransactionID", *CATEGORICAL))


def _encoded(spark, folder, **limits):
    train, val = _sides(spark, folder)
    fitted = prep.fit_prep(train, NUMERIC, CATEGORICAL, **limits)
    return rounded(fitted.encode(val, ["TransactionID"]), *fitted.feature_names)


@query
def ordinal_encode(spark, folder):
    return _encoded(spark, folder)


@query
def ordinal_encode_broadcast(spark, folder):
    return _encoded(spark, folder, lookup_limit=0)


@query
def ordinal_encode_shuffled(spark, folder):
    return _encoded(spark, folder, lookup_limit=0, budget=0)


@query
def reloaded_prep(spark, folder):
    """The codes of a fitted preparation that was read back from its folder."""
    train, val = _sides(spark, folder)
    path = scratch_path(spark, "prep")
    prep.fit_prep(train, NUMERIC, CATEGORICAL, path)
    fitted = prep.Prep.load(spark, path)
    return rounded(fitted.encode(val, ["TransactionID"]), *fitted.feature_names)


@query
def preprocess_report(spark, folder):
    """The contract of the fitted columns, as one row."""
    data = clean.clean(transactions(spark, folder))
    cut = splits.time_cut(data, "ts")
    train, val = splits.time_split(data, cut, "ts")
    fitted = prep.fit_prep(train, NUMERIC, CATEGORICAL)
    unseen = prep.unseen_categories(train, val, CATEGORICAL)
    about = fitted.report(train.count(), val.count(), unseen, "ts", str(cut))
    rows, width = about["train_shape_after_transform"]
    row = (
        about["t_cut"], about["n_numeric"], about["n_categorical"], ",".join(about["feature_order"]), rows, width,
        about["val_shape_after_transform"][0], sum(about["unseen_val_categories_mapped_to_-1"].values()),
    )
    return spark.createDataFrame(
        [row],
        "t_cut string, n_numeric bigint, n_categorical bigint, feature_order string, train_rows bigint, width bigint, "
        "val_rows bigint, unseen bigint",
    )


@query
def unseen_categories(spark, folder):
    return rounded(prep.unseen_categories(*_sides(spark, folder), CATEGORICAL))


@query
def class_weight(spark, folder):
    data = scored(spark, folder)
    cut = splits.time_cut(data, "time")
    row = splits.split_report(data, cut, "time", "y").filter("side = 'train'").first()
    return spark.createDataFrame(
        [(row["pos"], row["neg"], boost.class_weight(row["pos"], row["neg"]))],
        "pos bigint, neg bigint, scale_pos_weight double",
    )


def _trained(spark, folder):
    train, val = _sides(spark, folder)
    fitted = prep.fit_prep(train, NUMERIC, CATEGORICAL)
    sides = [stored(fitted.vectors(s, ["TransactionID", "ts", "isFraud"]), "vectors") for s in (train, val)]
    pos, rows = train.agg(F.sum("isFraud"), F.count(F.lit(1))).first()
    return fitted, sides, boost.class_weight(pos, rows - pos)


def _content(spark, folder) -> tuple:
    return spark.sparkContext.applicationId, *tables.fingerprint(transactions(spark, folder)).first()


def _model(spark, folder):
    """The trained model and the validation side; queries of one session share the training on equal rows."""
    fitted, (train, val), weight = _trained(spark, folder)
    key = _content(spark, folder)
    if key not in _MODELS:
        _MODELS[key] = boost.train(train, val, "isFraud", fitted.feature_names, weight)
    return _MODELS[key], val


@query
def gbt_scores(spark, folder):
    model, val = _model(spark, folder)
    return rounded(clean.to_score_schema(model.score(val), "TransactionID", "ts", "isFraud"), "score")


@query
def gbt_importances(spark, folder):
    return boost.importances(spark, _model(spark, folder)[0])


@query
def staged_auc(spark, folder):
    """The validation curve after each tree, as the training that watched it has stored it."""
    return _model(spark, folder)[0].stages


@query
def fold_sizes(spark, folder):
    data = scored(spark, folder)
    parts = []
    for i, (begin, end) in enumerate(zip(CV_CUTS, CV_CUTS[1:])):
        for side, rows in (
            ("train", clean.time_between(data, "time", upto=begin)),
            ("val", clean.time_between(data, "time", after=begin, upto=end)),
        ):
            counts = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("y") == 1).alias("pos"))
            parts.append(counts.withColumn("fold", F.lit(i)).withColumn("side", F.lit(side)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return rounded(result)


def _folds(spark, folder):
    key = _content(spark, folder)
    if key not in _FOLDS:
        train, _ = _sides(spark, folder)
        fitted = prep.fit_prep(train, NUMERIC, CATEGORICAL)
        data = clean.clean(transactions(spark, folder))
        _FOLDS[key] = boost.time_cv(data, fitted, "ts", "isFraud", CV_CUTS)
    return _FOLDS[key]


@query
def time_cv(spark, folder):
    return _folds(spark, folder)


@query
def fold_summary(spark, folder):
    return profile.fold_summary(_folds(spark, folder))
