"""The corpus pipeline, each stage against SQL or a plain version over the stage's own input."""

from collections import Counter

import pytest
from conftest import FOLDER
from test_tokens import check_packing

import corpus_pipeline
from alertline.llm.oracles import ORACLES, near_duplicates_sql
from alertline.llm.queries import QUERIES
from alertline.session import stored


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], FOLDER), name))
    return out


def by_sql(duck, sql, docs):
    """Some SQL over the rows of a stage's input."""
    duck.execute("DROP VIEW documents")
    duck.register("documents", docs.toPandas())
    return duck.execute(sql).fetch_df()


def test_columns_and_order(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "quality_rules", "near_duplicates", "source_mixing", "best_fit_packing",
    ]
    for docs in stages[:-1]:
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS


def test_classifier_stage(spark, stages):
    kept = {r.doc_id for r in stages[1].collect()}
    scores = QUERIES["op7_quality_classifier"](spark, FOLDER).collect()
    assert kept == {r.doc_id for r in scores if r.predicted == 1}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = [d for d, q in quality.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good)


def test_rules_stage(duck, stages):
    judged = by_sql(duck, ORACLES["op5_quality_rules"], stages[1])
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(judged[judged.kept].doc_id)


def test_near_duplicate_stage(duck, stages):
    judged = by_sql(duck, near_duplicates_sql(corpus_pipeline.NEAR_PERCENT), stages[2])
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(judged[judged.kept].doc_id)


def test_mixing_stage(duck, stages):
    mixed = by_sql(duck, ORACLES["op4_source_mixing"], stages[3])
    times = {d: t // s if s else 0 for d, s, t in zip(mixed.doc_id, mixed["size"], mixed.taken)}
    assert Counter(r.doc_id for r in stages[4].collect()) == Counter({d: t for d, t in times.items() if t})


def test_packing_stage(stages):
    docs = [(r.doc_id, r.text) for r in stages[4].collect()]
    check_packing(stages[5].collect(), docs)


def test_run_equals_the_stages(spark, stages):
    rows = ("doc_id", "piece", "start", "length", "ids_crc32")
    ran = corpus_pipeline.run(spark, FOLDER).select(*rows).collect()
    assert Counter(ran) == Counter(stages[5].select(*rows).collect())
