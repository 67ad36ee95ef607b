"""A training corpus from raw documents, in five stages that each build on what the one before kept.

Every stage is a function of (spark, docs, folder of the tables) and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each stage to the shared folder in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertline.llm.lines import quality_verdict
from alertline.llm.mixing import mix, repeat_taken
from alertline.llm.neardup import drop_near_duplicates
from alertline.llm.packing import pack, token_pieces
from alertline.llm.queries import table, tokenizer
from alertline.llm.rules import score_quality, train
from alertline.llm.text import keep_where
from alertline.session import stored

#: Near-duplicates of the corpus: sets of 5-word shingles with a resemblance of 0.8 or more (op3 has a rule of its own).
NEAR_PERCENT = 80

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: No SQL: tokenizing, tree growing and hashing of shingles are not expressible. The tests hold the result
#: against a brute-force version of every stage.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the rule ensemble, fitted on the labels of these documents, scores 0.5 or more."""
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = score_quality(docs, model).withColumn("_good", F.col("predicted") == 1)
    return keep_where(scored, "_good").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the base rules and lose little text to the line rules."""
    return keep_where(quality_verdict(docs), "kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return drop_near_duplicates(docs, NEAR_PERCENT).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and drop documents so that sources meet their target weights."""
    return repeat_taken(mix(docs)).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the token pieces of the documents in sequences of 2048."""
    pieces = token_pieces(docs, tokenizer("byte_bpe_50k.json"), end_id=0)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table; the packed pieces."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
