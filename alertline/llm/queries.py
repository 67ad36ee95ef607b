"""Named queries of the training-data operators: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertline.llm.bpe import decode_ids, encode_texts
from alertline.llm.fingerprints import hex_string, with_fingerprint, with_next_document, with_resemblance
from alertline.llm.licenses import scan_licenses
from alertline.llm.lines import quality_verdict
from alertline.llm.mixing import mix, taken
from alertline.llm.neardup import near_duplicates
from alertline.llm.packing import pack, token_pieces
from alertline.llm.records import document_spans, write_records
from alertline.llm.repair import repair, summaries
from alertline.llm.rules import HELD_OUT_FOLD, fold, score_quality, train
from alertline.llm.runs import find_runs
from alertline.llm.text import words
from alertline.llm.toolcalls import calls_of_turns, link_calls, other_turns
from alertline.llm.warc import read_archives, write_archives
from alertline.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where the installed vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness to the next document's."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next_document(
        docs, ["text", "fingerprint"], derive=lambda df: with_fingerprint(df, "text", "fingerprint")
    )
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    docs = docs.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    docs = with_fingerprint(docs.drop("text", "next_text"), "edited", "edited_fingerprint")
    docs = with_resemblance(docs, "fingerprint", "edited_fingerprint", "near_edited")
    docs = with_resemblance(docs, "fingerprint", "next_fingerprint", "near_next")
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        hex_string("fingerprint").alias("fingerprint"),
        hex_string("edited_fingerprint").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query
def op2_token_records(spark: SparkSession, folder: str) -> DataFrame:
    """Write all documents as token records, and read spans and checksums back from the files."""
    store = scratch_path(spark, "records")
    index = write_records(
        table(spark, folder, "documents"), store, tokenizer("word_bpe_49k.json"), drops_spaces=True, end_id=2
    )
    return document_spans(spark, store, index)


@query
def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(table(spark, folder, "documents"))


@query
def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How often the mix takes each of all documents."""
    mixed = mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", taken(mixed).cast("long").alias("taken"))


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and the verdict of the line rules for all documents."""
    judged = quality_verdict(table(spark, folder, "documents").select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *counts, "base_failed", "kept", "lost_share")


@query
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Write all pages to WARC archives, and read the records back."""
    store = scratch_path(spark, "warc")
    manifest = write_archives(table(spark, folder, "pages"), store)
    records = read_archives(spark, store, manifest)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents by a rule ensemble fitted outside the held-out fold."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, table(spark, folder, "labels").select("doc_id", "quality"))
    held_out = (fold() == HELD_OUT_FOLD).alias("held_out")
    return score_quality(docs, model).select("doc_id", held_out, "score", "predicted")


@query
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence templates in all documents."""
    return scan_licenses(table(spark, folder, "documents"))


@query
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Place the token pieces of all documents in sequences of 2048."""
    pieces = token_pieces(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query
def op10_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Tool calls that stand for the turns of all conversations, linked, ordered and serialised."""
    turns = table(spark, folder, "conversations")
    calls, results = calls_of_turns(turns)
    return link_calls(calls, results).unionByName(other_turns(turns))


def with_damage(turns: DataFrame) -> DataFrame:
    """Conversations of which some turns, by crc32 of conv_id:turn, are dropped, emptied, cut, repeated or reroled.

    A null is one space.
    """
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    damaged = turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return damaged.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("copies", "copy")


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repairs of all conversations, some turns of which are damaged first."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = summaries(repair(with_damage(turns))).withColumnRenamed("conv_id", "_conv_id")
    rows = turns.select("conv_id").distinct().join(found, F.expr("conv_id <=> _conv_id"), "left").drop("_conv_id")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return rows.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


@query
def op12_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents and the texts they decode to, as digests."""
    path = tokenizer("byte_bpe_50k.json")
    docs = decode_ids(encode_texts(table(spark, folder, "documents").select("doc_id", "text"), path), path)
    return docs.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, by crc32 of the doc_id, repeat some of their words from a place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(all_words: Column) -> Column:
        n = F.size(all_words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        period = F.slice(all_words, (a + 1).cast("int"), p.cast("int"))
        tail = F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int")))
        changed = F.concat(F.slice(all_words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
        return F.when(n > 0, F.concat_ws(" ", changed)).otherwise("")

    periodic = F.element_at(F.transform(F.array(words(F.col("text"))), repeated), 1)
    return docs.withColumn("text", F.when(h % 10 == 0, periodic).otherwise(F.col("text")))


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of words in all documents, some of which are made periodic first."""
    docs = find_runs(with_periods(table(spark, folder, "documents").select("doc_id", "text")))
    # the greatest length first, then the smallest start, then the smallest period
    order = F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period")))
    best = F.array_min(order)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    docs = docs.select("doc_id", "runs", "collapsed", best.alias("best"))
    return docs.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
