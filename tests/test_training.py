import math
import re
from threading import Event

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alertline.operators import boost, prep
from alertline.operators.clean import clean
from alertline.plans import training
from alertline.plans.fixtures import transactions
from alertline.session import scratch_path
from alertline.sources import sinks

FOLDER = "/root/testdata/sf0.01"
SMALL = {"max_iterations": 4, "maxDepth": 3}


@pytest.fixture(scope="module")
def sides(spark):
    """Raw CSV files through ingest, cleaning, split and fitted preparation."""
    raw, store = scratch_path(spark, "raw"), scratch_path(spark, "store")
    rows = transactions(spark, FOLDER).drop("ts")
    sinks.write_csv(rows.drop("DeviceInfo"), f"{raw}/t")
    sinks.write_csv(rows.filter("TransactionID % 4 > 0").select("TransactionID", "DeviceInfo"), f"{raw}/i")
    training.ingest(spark, {"train_transaction": f"{raw}/t", "train_identity": f"{raw}/i"}, store)
    table = training.prepare(spark, f"{store}/clean")
    report = training.sanity_report(table)
    assert report["n_rows"] == 10_000 and report["n_cols"] == 13
    assert "sparse95" not in table.columns and "sparse90" in table.columns
    assert next(iter(report["top_missing"])) == "sparse90"
    return training.split_and_fit(table, f"{store}/prep")


@pytest.fixture(scope="module")
def model(sides):
    return training.fit_model(sides, **SMALL)


def test_split_and_features(sides):
    assert sides.split["train"]["rows"] == 8_000 and sides.split["val"]["rows"] == 2_000
    assert sides.features.numeric == ["C1", "TransactionAmt", "sparse90"]
    assert sides.features.categorical == ["DeviceInfo", "ProductCD"]


def test_preparation_equals_pandas(spark, sides):
    columns = ["TransactionID", *sides.prep.numeric, *sides.prep.categorical]
    train, val = (s.select(*columns).toPandas() for s in (sides.train, sides.val))
    got = sides.prep.encode(sides.val, ["TransactionID"]).toPandas().sort_values("TransactionID")
    val = val.sort_values("TransactionID")
    for c in sides.prep.numeric:
        filled = val[c].astype(float).fillna(train[c].median())
        assert np.array_equal(got[f"num__{c}"].to_numpy(), filled.to_numpy()), c
    for c in sides.prep.categorical:
        mode = train[c].mode().min()
        known = {v: i for i, v in enumerate(sorted(train[c].dropna().unique()))}
        codes = val[c].fillna(mode).map(known).fillna(-1)
        assert np.array_equal(got[f"cat__{c}"].to_numpy(), codes.to_numpy()), c
    report = training.preprocess_report(sides)
    assert report["val_shape_after_transform"] == [2000, 5]
    unseen = report["unseen_val_categories_mapped_to_-1"]
    for c in sides.prep.categorical:
        assert unseen[c] == len(set(val[c].dropna()) - set(train[c].dropna()))


def test_codes_of_every_size(spark, sides, monkeypatch):
    """Looked up, broadcast or joined by shuffle: the codes are the same."""
    path = scratch_path(spark, "prep")
    fitted = prep.fit_prep(sides.train, sides.prep.numeric, sides.prep.categorical, path)
    assert set(fitted.labels) == {"ProductCD"}  # DeviceInfo has about 1,500 values
    want = fitted.encode(sides.val, ["TransactionID"])
    for lookup, budget, plan in ((10**9, 10**9, "UDF"), (0, 10**9, "BroadcastHashJoin"), (0, 0, "SortMergeJoin")):
        loaded = prep.Prep.load(spark, path, lookup, budget)
        got = loaded.encode(sides.val, ["TransactionID"])
        assert plan in got._jdf.queryExecution().executedPlan().toString()
        assert got.exceptAll(want).isEmpty() and got.count() == 2_000


def codes_of(rows, columns):
    """Ordinal codes and modes of plain rows."""
    out = {}
    for k, c in enumerate(columns):
        values = [r[k] for r in rows if r[k] is not None]
        mode = min(set(values), key=lambda v: (-values.count(v), v))
        out[c] = ({v: float(i) for i, v in enumerate(sorted(set(values)))}, mode)
    return out


def test_all_columns_share_one_budget(spark):
    """Thirty columns near the limit of one: together they stay within it, the rest are joined by shuffle."""
    columns = [f"c{k}" for k in range(30)]
    rows = [tuple(f"{c}-{i % (20 + k)}" for k, c in enumerate(columns)) for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    path = scratch_path(spark, "prep")
    fitted = prep.fit_prep(df, [], columns, path)
    sizes = fitted.code_bytes
    budget = 7 * max(sizes.values())
    for lookup, held in ((0, lambda p: p.broadcast_columns()), (10**6, lambda p: set(p.labels) | p.broadcast_columns())):
        loaded = prep.Prep.load(spark, path, lookup, budget)
        chosen = held(loaded)
        assert 7 <= len(chosen) < 30 and sum(sizes[c] for c in chosen) <= budget
    codes = codes_of(rows, columns)
    loaded = prep.Prep.load(spark, path, 0, 3 * max(sizes.values()))
    got = loaded.encode(df).limit(5).collect()
    known = [tuple(codes[c][0][v] for c, v in zip(columns, r)) for r in rows]
    assert all(tuple(r) in known for r in got)


def test_a_mode_on_most_rows_is_spread(spark, monkeypatch):
    """Gaps and frequent values make no hot key, and every row keeps its code."""
    monkeypatch.setattr(prep, "ROWS_OF_KEY", 20)
    monkeypatch.setattr(prep, "HEAVY_SHARE", 4)
    values = [None] * 600 + ["mode"] * 300 + [f"often{k % 3}" for k in range(180)] + [f"v{k}" for k in range(20)]
    rows = [(k, v) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, c string")
    fitted = prep.fit_prep(df, [], ["c"], lookup_limit=0, budget=0)
    codes, mode = codes_of([(v,) for v in values], ["c"])["c"]
    assert set(fitted.heavy["c"]) == {"mode"} and min(fitted.salts["c"].values()) >= 3
    other = df.unionByName(spark.createDataFrame([(5000, "unknown"), (5001, "")], df.schema))
    got = {r["id"]: r["cat__c"] for r in fitted.encode(other, ["id"]).collect()}
    assert got == {5000: -1.0, 5001: -1.0, **{k: codes[v or mode] for k, v in rows}}
    seen = []
    real = type(df).join

    def join(left, right, on=None, how=None):
        if on == ["_key", "_salt"]:
            seen.append(left.groupBy("_key", "_salt").count().agg(F.max("count")).first()[0])
        return real(left, right, on, how)

    monkeypatch.setattr(type(df), "join", join)
    fitted.encode(df, ["id"]).count()
    assert seen and seen[0] < 60  # 900 rows hold the mode, 60 each of three others


def test_saved_preparation(spark, sides):
    path = scratch_path(spark, "prep")
    fitted = prep.fit_prep(sides.train, sides.prep.numeric, sides.prep.categorical, path)
    loaded = prep.Prep.load(spark, path)
    assert loaded.feature_names == fitted.feature_names == sides.prep.feature_names
    assert loaded.encode(sides.val, ["TransactionID"]).exceptAll(sides.prep.encode(sides.val, ["TransactionID"])).isEmpty()


def test_category_order_of_any_text(spark):
    """Long common prefixes, empty text, other scripts and upper case keep their byte order."""
    values = ["", "a", "A", "é", "z" * 20 + "1", "z" * 20 + "2", "z" * 20, "日本", "\U0001f600", "a b", "0", "10", "9"]
    df = spark.createDataFrame([(v,) for v in values * 3], "c string")
    codes = {r["value"]: r["code"] for r in prep.category_codes(prep.value_counts(df, ["c"])).collect()}
    assert codes == {v: float(i) for i, v in enumerate(sorted(values))}


def test_categories_that_begin_alike_are_spread(spark, monkeypatch):
    """Ten thousand texts that share 200 bytes lie in ranges of about equal size."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = []

    def stored(df, name):
        placed.append(real(df, name))
        return placed[-1]

    real = prep.stored
    monkeypatch.setattr(prep, "stored", stored)
    try:
        values = ["p" * 200 + f"{k * 7919 % 10_000:05d}" for k in range(10_000)]
        counts = spark.createDataFrame([("c", v, 1) for v in values], "column string, value string, n long")
        codes = prep.category_codes(counts).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["value"]: r["code"] for r in codes} == {v: float(i) for i, v in enumerate(sorted(values))}
    sizes = [r["count"] for r in placed[0].groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2.5 * 10_000 / len(sizes)


def test_mode_ties_and_empty_columns(spark):
    df = spark.createDataFrame([("b", None, 1.0, None), ("a", None, 2.0, None)], "t string, e string, n double, m double")
    assert prep.modes(prep.value_counts(df, ["t", "e"])) == {"t": ("a", 2 * (prep.ENTRY_BYTES + 1))}
    assert prep.medians(df, ["n", "m"]) == {"n": 1.5, "m": None}
    fitted = prep.fit_prep(df, ["n", "m"], ["t", "e"])
    assert fitted.feature_names == ["num__n", "cat__t"]


def test_best_iteration_rule():
    aucs = {1: 0.5, 2: 0.7, 3: 0.7, 4: 0.6, 5: 0.9}
    assert boost.best_iteration(aucs, patience=100) == 5
    assert boost.best_iteration(aucs, patience=2) == 2
    assert boost.best_iteration({1: None, 2: 0.4}) == 2


def rounded(tree):
    return re.sub(r"-?[0-9]+[.][0-9]+", lambda number: f"{float(number[0]):.9g}", tree)


def test_training_goes_on_from_stored_margins(spark, sides, monkeypatch):
    """Stores after every two trees change neither the trees nor their AUC, and each tree is fitted once."""
    vectors = [boost.stored(sides.prep.vectors(s, ["isFraud"]), "side") for s in (sides.train, sides.val)]
    fitted, forest, fit = [], boost.RandomForestRegressor, boost.GBTClassifier

    def counted(**parameters):
        fitted.append(parameters["seed"])
        return forest(**parameters)

    def counted_at_once(**parameters):
        fitted.extend(range(parameters["seed"], parameters["seed"] + parameters["maxIter"]))
        return fit(**parameters)

    monkeypatch.setattr(boost, "RandomForestRegressor", counted)
    monkeypatch.setattr(boost, "GBTClassifier", counted_at_once)
    monkeypatch.setattr(boost, "best_iteration", lambda aucs, patience: len(aucs))  # always goes on
    models = []
    for at_once in (2, 6):
        monkeypatch.setattr(boost, "STAGES_AT_ONCE", at_once)
        models.append(
            boost.train(*vectors, "isFraud", sides.prep.feature_names, 3.0, patience=7 - at_once, max_iterations=8, maxDepth=2)
        )
        assert fitted == [*range(42, 50)]
        fitted.clear()
    assert [m.iterations for m in models] == [8, 8]
    assert list(models[0].model.treeWeights) == [1.0, *[0.05] * 7]


def test_trees_grow_while_earlier_ones_are_judged(sides, monkeypatch):
    """Once some of the AUCs ask for more trees, these do not wait for the other AUCs."""
    vectors = [boost.stored(sides.prep.vectors(s, ["isFraud"]), "side") for s in (sides.train, sides.val)]
    stages, grow, grown, waited = boost._stages, boost.grow, Event(), []

    def judged(margins, trees, before):
        if before == 2:
            waited.append(grown.wait(60))
        return stages(margins, trees, before)

    def growing(*args, **parameters):
        grown.set()
        return grow(*args, **parameters)

    monkeypatch.setattr(boost, "_stages", judged)
    monkeypatch.setattr(boost, "grow", growing)
    monkeypatch.setattr(boost, "STAGES_AT_ONCE", 2)
    monkeypatch.setattr(boost, "best_iteration", lambda aucs, patience: max(1, len(aucs)))
    model = boost.train(*vectors, "isFraud", sides.prep.feature_names, 3.0, patience=3, max_iterations=6, maxDepth=2)
    assert waited == [True] and len(model.model.trees) == model.iterations == 6


def test_training_keeps_the_stages_it_watched(sides, model):
    vectors = sides.prep.vectors(sides.val, ["isFraud"])
    kept, again = (
        [tuple(r) for r in df.orderBy("iteration").collect()]
        for df in (model.stages, boost.staged_auc(model.model, vectors, "isFraud"))
    )
    assert len(kept) == len(model.model.trees) == len(again)
    assert all(a == pytest.approx(b, rel=1e-9) for a, b in zip(kept, again))


def test_one_fit_and_single_trees_agree(sides):
    """Without a draw of rows and features, the trees of one fit equal those that are fitted one after the other."""
    margins = boost._spread(boost.start_margins(sides.prep.vectors(sides.train, ["isFraud"]), "isFraud", 3.0))
    whole = {"maxDepth": 2, "featureSubsetStrategy": "all", "subsamplingRate": 1.0}
    once = boost.begin(margins, 4, **whole)
    start = boost.Trees(once.trees[:2], once.weights[:2])
    after = start + boost.grow(boost.stored(start.add_margin(margins), "margins"), 2, 2, **whole)
    one, other = ([rounded(t.toDebugString.split("\n", 1)[1]) for t in trees.trees] for trees in (once, after))
    assert one == other and once.weights == after.weights


def test_training_stops_after_the_patience(sides, monkeypatch):
    """A step of nothing never gains, so the patience ends it; no tree is fitted beyond that."""
    vectors = [boost.stored(sides.prep.vectors(s, ["isFraud"]), "side") for s in (sides.train, sides.val)]
    model = boost.train(*vectors, "isFraud", sides.prep.feature_names, patience=3, maxDepth=1, stepSize=1e-12)
    assert len(model.model.trees) == model.iterations + 3


def test_first_trees_follow_the_gradient(sides):
    """The mean of a leaf is the weighted mean of the negative gradient of its rows."""
    rows = sides.prep.vectors(sides.train, ["isFraud"]).limit(4000).cache()
    margins = boost.start_margins(rows, "isFraud", 3.0)
    whole = {"maxDepth": 1, "featureSubsetStrategy": "all", "subsamplingRate": 1.0}
    trees = boost.grow(margins, 2, **whole)
    first = boost.Trees(trees.trees[:1], trees.weights[:1])
    moved = first.add_margin(margins).withColumn("y", F.expr("4 * sign / (1 + exp(2 * sign * margin))"))
    leaves = boost.tree_outputs(boost.Trees(trees.trees[1:], (1.0,)).classifier(), moved).withColumn("leaf", F.col("outputs")[0])
    means = leaves.groupBy("leaf").agg((F.sum(F.expr("y * weight")) / F.sum("weight")).alias("mean")).collect()
    assert means and all(math.isclose(r["leaf"], r["mean"], rel_tol=1e-6, abs_tol=1e-9) for r in means)


def test_scores_equal_mllib(sides, model):
    vectors = sides.prep.vectors(sides.val, ["TransactionID"])
    from pyspark.ml.functions import vector_to_array

    full = boost.score_trees(model.model, vectors)
    theirs = model.model.transform(vectors).select("TransactionID", vector_to_array("probability")[1].alias("p"))
    assert full.join(theirs, "TransactionID").filter("abs(score - p) > 1e-9").isEmpty()


def test_stages_equal_single_scores(sides, model):
    vectors = sides.prep.vectors(sides.val, ["isFraud"])
    stages = {r["iteration"]: r["roc_auc"] for r in boost.staged_auc(model.model, vectors, "isFraud").collect()}
    assert model.iterations == max(stages, key=lambda i: (stages[i], -i))
    from alertline.operators.curves import roc_auc

    for i in (1, len(stages)):
        single = roc_auc(boost.score_trees(model.model, vectors, i), "score", "isFraud").first()[0]
        assert math.isclose(stages[i], single, rel_tol=1e-9)


def test_saved_model(spark, sides, model):
    path = scratch_path(spark, "model")
    model.save(path)
    loaded = boost.TrainedModel.load(path)
    vectors = sides.prep.vectors(sides.val, ["TransactionID"])
    same = model.score(vectors).select("TransactionID", "score")
    assert loaded.score(vectors).select("TransactionID", "score").exceptAll(same).isEmpty()
    top = boost.importances(spark, loaded, 3).collect()
    assert len(top) == 3 and top[0]["gain"] >= top[1]["gain"] and top[0]["feature"].startswith(("num__", "cat__"))


def test_frozen_scores_and_summary(spark, sides, model):
    path = scratch_path(spark, "scores")
    frozen = training.freeze_scores(sides, model, path, "r1")
    about = sinks.read_report(spark, f"{path}.about")
    assert (about["run_id"], about["rows_val"]) == ("r1", frozen.count())
    assert frozen.columns == ["id", "time", "y", "score"] and frozen.count() == 2_000
    summary = training.training_summary(model, frozen)
    assert 0.5 < summary["roc_auc"] <= 1 and summary["best_iteration"] == model.iterations
    at_half, at_best = summary["thr_0_5"], summary["thr_best_f1"]
    assert sum(at_half[c] for c in ("tp", "fp", "tn", "fn")) == 2_000
    assert at_best["f1"] >= at_half["f1"]
    assert math.isclose(at_best["precision"], at_best["precision_curve"])
    assert set(summary["precision_at_k"]) == {"0.005", "0.01", "0.02", "0.05"}


@pytest.mark.parametrize("refit", [False, True])
def test_rolling_folds(spark, sides, refit):
    data = clean(transactions(spark, FOLDER))
    cuts = ("2024-01-10", "2024-01-17", "2024-01-24")
    folds = boost.time_cv(data, sides.prep, "ts", "isFraud", cuts, refit=refit, max_iterations=2, maxDepth=2).collect()
    assert [(r["fold"], r["train_end"], r["val_end"]) for r in folds] == [(0, *cuts[:2]), (1, *cuts[1:])]
    assert all(0.5 < r["roc_auc"] <= 1 and 1 <= r["best_iter"] <= 2 for r in folds)


def test_cleaning_and_scoring_work_on_a_stream(spark, sides, model):
    """Both are row-wise, so the batch functions apply to a stream as they are."""
    folder = scratch_path(spark, "stream")
    vectors = sides.prep.vectors(sides.val, ["TransactionID"])
    vectors.write.parquet(folder)
    stream = spark.readStream.schema(vectors.schema).parquet(folder)
    running = model.score(clean(stream)).select("TransactionID", "score").writeStream.format("memory").queryName("streamed").start()
    try:
        running.processAllAvailable()
        batch = model.score(vectors).select("TransactionID", "score")
        assert spark.table("streamed").exceptAll(batch).isEmpty() and spark.table("streamed").count() == 2_000
    finally:
        running.stop()


def test_unseen_only_counts_new_values(spark):
    train = spark.createDataFrame(pd.DataFrame({"a": ["x", "y"], "b": ["1", "1"]}))
    other = spark.createDataFrame(pd.DataFrame({"a": ["z", "z"], "b": ["1", "1"]}))
    got = {r["column"]: r["unseen"] for r in prep.unseen_categories(train, other, ["a", "b"]).collect()}
    assert got == {"a": 1, "b": 0}
    assert prep.unseen_categories(train.withColumn("a", F.lit(None).cast("string")), other, ["a"]).first()["unseen"] == 1


def test_side_by_side_trees_equal_mllib(sides, monkeypatch):
    """Draws of rows included, the trees of one barrier stage are those that MLlib fits one level at a time."""
    margins = boost.stored(boost._spread(boost.start_margins(sides.prep.vectors(sides.train, ["isFraud"]), "isFraud", 3.0)), "margins")
    monkeypatch.setattr("alertline.operators.trees.LEAST_ROWS", 2_000)  # several tasks add up their histograms
    new = boost.begin(margins, 12)
    start = boost.stored(new.add_margin(margins), "margins")  # MLlib draws by the order of the parts, so both begin here
    later = boost.grow(start, 4, 12)
    monkeypatch.setattr(boost, "can_run_side_by_side", lambda spark: False)
    old = boost.begin(margins, 12)
    after = boost.grow(start, 4, 12)
    for name, ours, theirs in (("first", new, old), ("later", later, after)):
        assert ours.weights == theirs.weights
        rows = boost.stored(sides.prep.vectors(sides.val, ["TransactionID"]).withColumn("margin", F.lit(0.0)), "rows")
        both = ours.add_margin(rows).withColumnRenamed("margin", "a").join(
            theirs.add_margin(rows).withColumnRenamed("margin", "b"), "TransactionID"
        )
        assert both.filter("abs(a - b) < 1e-9").count() == 2_000, name
    ours, theirs = (t.classifier().featureImportances.toArray() for t in (new, old))
    assert np.allclose(ours, theirs, rtol=1e-9)


def test_a_series_is_one_stage(spark, sides):
    """A hundred trees take a few jobs, not several for each level of each tree."""
    margins = boost.stored(boost.start_margins(sides.prep.vectors(sides.train, ["isFraud"]), "isFraud", 3.0), "margins")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("series", "trees of one series")
    try:
        assert len(boost.grow(margins, 40, 1)) == 40
        assert len(tracker.getJobIdsForGroup("series")) < 40
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_stages_cut_into_ranges_agree(spark, monkeypatch):
    """AUC and precision do not depend on the number of ranges, with heavy ties and missing labels."""
    from alertline.operators import curves

    rows = [(k % 3 if k % 7 else None, float(k % 5), [float(k * 37 % 101 // 4), float(k % 2), -float(k % 11)]) for k in range(3000)]
    df = spark.createDataFrame(rows, "y int, margin double, outputs array<double>")
    whole = {tuple(r)[0]: tuple(r) for r in curves.staged_curves(df, 4, 3000).collect()}
    monkeypatch.setattr(curves, "STAGE_ROWS", 400)
    monkeypatch.setattr(curves, "STAGE_CELLS", 900)
    cut = {tuple(r)[0]: tuple(r) for r in curves.staged_curves(df, 4, 3000).collect()}
    assert sorted(whole) == sorted(cut) == [5, 6, 7]
    for k in whole:
        scores = df.select("y", (F.col("margin") + sum(F.col("outputs")[i] for i in range(k - 4))).alias("score"))
        want = curves.curve_summary(scores, "score", "y").first()
        assert whole[k] == pytest.approx((k, want["roc_auc"], want["average_precision"]), rel=1e-12)
        assert cut[k] == pytest.approx(whole[k], rel=1e-12)


def test_trees_beyond_the_rule_are_dropped(sides, monkeypatch):
    """A series may grow too many trees while it is judged; the model and its stages end where the rule says."""
    vectors = [boost.stored(sides.prep.vectors(s, ["isFraud"]), "side") for s in (sides.train, sides.val)]
    monkeypatch.setattr(boost, "STAGES_AT_ONCE", 3)
    model = boost.train(*vectors, "isFraud", sides.prep.feature_names, patience=5, maxDepth=1, stepSize=1e-12)
    assert len(model.model.trees) == model.iterations + 5 == model.stages.count()
