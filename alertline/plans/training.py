"""From raw tables to frozen scores: ingest, clean, split, prepare, train, evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertline.functions.scalar import micros_literal
from alertline.operators.boost import TrainedModel, class_weight, importances, train
from alertline.operators.clean import FeatureReport, add_time_features, drop_sparse, feature_report, select_contract, to_score_schema, without_nan
from alertline.operators.curves import best_f1, curve_summary, threshold_metrics
from alertline.operators.points import precision_at_k, recall_at_fpr
from alertline.operators.prep import Prep, fit_prep, unseen_categories
from alertline.operators.profile import class_balance, missing_profile
from alertline.operators.quality import enforce, score_checks, split_checks, table_checks
from alertline.operators.splits import split_report, time_cut, time_split
from alertline.session import stored
from alertline.sources.sinks import run_metadata, write_parquet, write_report
from alertline.sources.tables import create_joined_view, fingerprint, load_csv, load_dataset, load_joined

LABEL, TIME, KEY = "isFraud", "dt", "TransactionID"


def ingest(spark: SparkSession, raw: dict[str, str], store: str) -> None:
    """Load ``{table: csv path}`` and create ``<side>_joined`` for each side with both of its tables."""
    for name, path in raw.items():
        load_csv(spark, name, path, f"{store}/{name}")
    for side in sorted({n.split("_")[0] for n in raw}):
        if {f"{side}_transaction", f"{side}_identity"} <= set(raw):
            create_joined_view(spark, f"{side}_joined", f"{side}_transaction", f"{side}_identity")


def prepare(spark: SparkSession, out: str, limit: int | None = None) -> DataFrame:
    """The cleaned table: joined rows without sparse columns, with time features.

    The joined rows are stored first, as the missing rates are counted some columns at a time.
    """
    table = add_time_features(drop_sparse(stored(load_joined(spark, limit=limit), "joined")))
    write_parquet(table, out)
    return load_dataset(spark, out)


def sanity_report(df: DataFrame, top: int = 10, head: int = 20) -> dict:
    """Shape, first columns, class balance and the emptiest columns of a table that passes its checks."""
    enforce(table_checks(df, LABEL, TIME))
    balance = class_balance(df, LABEL).first().asDict()
    return {
        "n_rows": balance["total"],
        "n_cols": len(df.columns),
        "head_columns": df.columns[:head],
        "time_column": TIME,
        "class_balance": balance,
        "top_missing": {r["column"]: r["missing_rate"] for r in missing_profile(df, top).collect()},
    }


@dataclass(frozen=True)
class PreparedSides:
    cut: int
    split: dict[str, dict]
    features: FeatureReport
    prep: Prep
    train: DataFrame
    val: DataFrame


def split_and_fit(df: DataFrame, path: str | None = None) -> PreparedSides:
    """Cut at the 80% time quantile, check the sides, fit imputers and codes on the train side."""
    cut = time_cut(df, TIME)
    sides = split_report(df, cut, TIME, LABEL)
    enforce(split_checks(sides))
    features = feature_report(df)
    contracted = select_contract(df, [*features.numeric, *features.categorical], [c for c in (KEY, TIME, LABEL) if c in df.columns])
    train_side, val_side = time_split(contracted, cut, TIME)
    prep = fit_prep(train_side, features.numeric, features.categorical, path)
    return PreparedSides(cut, {r["side"]: r.asDict() for r in sides.collect()}, features, prep, train_side, val_side)


def preprocess_report(sides: PreparedSides) -> dict:
    unseen = unseen_categories(sides.train, sides.val, sides.prep.categorical)
    return sides.prep.report(
        sides.split["train"]["rows"], sides.split["val"]["rows"], unseen, TIME, cut_text(sides)
    )


def cut_text(sides: PreparedSides) -> str:
    spark = sides.train.sparkSession
    return spark.range(1).select(micros_literal(sides.cut).cast("string")).first()[0]


def fit_model(sides: PreparedSides, **parameters) -> TrainedModel:
    """Trees with the class weight of the train side."""
    counts = sides.split["train"]
    return train(
        stored(sides.prep.vectors(sides.train, [LABEL]), "train"),
        stored(sides.prep.vectors(sides.val, [LABEL]), "val"),
        LABEL,
        sides.prep.feature_names,
        class_weight(counts["pos"], counts["neg"]),
        **parameters,
    )


def freeze_scores(sides: PreparedSides, model: TrainedModel, path: str, run_id: str | None = None) -> DataFrame:
    """Score the validation side, check the result, and store (id, time, y, score).

    With a ``run_id``, a report of what the scores were made from is written beside them (``<path>.about``).
    """
    scored = model.score(sides.prep.vectors(sides.val, [KEY, TIME, LABEL]))
    write_parquet(to_score_schema(scored, KEY, TIME, LABEL), path)
    frozen = sides.val.sparkSession.read.parquet(path)
    enforce(score_checks(frozen))
    if run_id is not None:
        spark = sides.val.sparkSession
        write_report(spark, run_metadata(frozen, run_id, cut_text(sides), TIME), f"{path}.about")
    return frozen


def evaluation_summary(scores: DataFrame, score: str = "score", y: str = "y") -> dict:
    """All threshold-free and threshold metrics of a score table in one record; NaN scores are missing."""
    scores = without_nan(scores, score)
    curve = curve_summary(scores, score, y).first()
    best = best_f1(scores, score, y).first()
    metrics = {r["threshold"]: r.asDict() for r in threshold_metrics(scores, [0.5, best["threshold"]], score, y).collect()}
    at_best = {**metrics[best["threshold"]], "precision_curve": best["precision"], "recall_curve": best["recall"]}
    source = fingerprint(scores).first()
    share = scores.agg(F.avg(y)).first()[0]
    return {
        "dataset": {"rows": source["n_rows"], "content_hash": source["content_hash"], "prevalence": share},
        "metrics": {
            "roc_auc": curve["roc_auc"],
            "pr_auc": curve["average_precision"],
            "pr_baseline": share,
            "thr_0_5": metrics[0.5],
            "thr_best_f1": at_best,
            "precision_at_k": {str(r["share"]): r["precision"] for r in precision_at_k(scores, score=score, y=y).collect()},
            "recall_at_fpr": {str(r["target_fpr"]): r["recall"] for r in recall_at_fpr(scores, score=score, y=y).collect()},
        },
    }


def training_summary(model: TrainedModel, scores: DataFrame) -> dict:
    top = importances(scores.sparkSession, model).collect()
    return {
        "best_iteration": model.iterations,
        "train_time_seconds": model.seconds,
        **evaluation_summary(scores)["metrics"],
        "top_importances_gain": [{"feature": r["feature"], "gain": r["gain"]} for r in top],
    }
