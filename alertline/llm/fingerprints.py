"""Document fingerprints: bottom-k sketches of shingle hashes, in column expressions only.

A fingerprint is the ascending array of the HASHES smallest distinct 64-bit hashes of a text's shingles
of five lower-cased words. Fewer words are one shingle; a text without words has an empty fingerprint.
Sketches of parts merge to the sketch of the whole. Two sketches estimate resemblance, containment and
the number of distinct shingles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertline.llm.text import SHINGLE_WORDS, words
from alertline.session import stored

HASHES = 256
FAN_IN = 256
BUCKET_ROWS = 16_384  # of a range of doc_ids, at most
LEAST_ROWS = 1024  # no range of fewer rows is cut for the sake of more tasks
QUANTILES = 128  # pieces that a full range is cut into, at most


def with_fingerprint(df: DataFrame, text: str, name: str, hashes: int = HASHES) -> DataFrame:
    """Add the fingerprint of a text column as ``name``; null and empty texts have an empty one.

    The steps are columns of their own, dropped at the end, so that each is worked out once.
    """
    w, h, s = (f"_{name}_{step}" for step in ("words", "hashes", "shingles"))
    df = df.withColumn(w, words(F.lower(F.col(text))))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    n = F.size(h)

    def shingle(x: Column, i: Column) -> Column:
        return F.xxhash64(x, *(F.get(F.col(h), i + j) for j in range(1, SHINGLE_WORDS)))

    first = F.slice(h, 1, F.greatest(n - (SHINGLE_WORDS - 1), F.lit(0)))
    whole = F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: F.hex(x)), "")))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(
        s, F.when(n >= SHINGLE_WORDS, F.transform(first, shingle)).when(n > 0, whole).otherwise(none)
    )
    df = df.withColumn(name, F.slice(F.sort_array(F.array_distinct(s)), 1, hashes))
    return df.drop(w, h, s)


def hex_string(fingerprint: str) -> Column:
    """A fingerprint as a string: 16 hex digits for each hash."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _both(a: str, b: str, hashes: int) -> tuple[Column, Column]:
    """The largest hash among the smallest of the union, and the hashes in both up to there."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, hashes)
    return union, F.array_intersect(a, b)


def with_resemblance(df: DataFrame, a: str, b: str, name: str, hashes: int = HASHES) -> DataFrame:
    """Add the estimated Jaccard likeness of two fingerprints, 0 to 1; equal ones, empty too, have 1.

    A null fingerprint is like nothing: 0.
    """
    union, common = _both(a, b, hashes)
    u, c = f"_{name}_union", f"_{name}_common"
    df = df.withColumn(u, union).withColumn(c, common)
    shared = F.size(F.array_intersect(u, c)) / F.size(u)
    value = F.when(F.size(u) == 0, F.lit(1.0)).otherwise(shared)
    return df.withColumn(name, F.coalesce(value, F.lit(0.0))).drop(u, c)


def with_containment(df: DataFrame, a: str, b: str, name: str, hashes: int = HASHES) -> DataFrame:
    """Add the estimated share of ``a``'s shingles that ``b`` has; an empty ``a`` is contained in all."""
    union, common = _both(a, b, hashes)
    u, c = f"_{name}_union", f"_{name}_common"
    df = df.withColumn(u, union).withColumn(c, common)
    mine = F.size(F.array_intersect(u, a))
    value = F.when(F.size(a) == 0, F.lit(1.0)).when(mine == 0, F.lit(0.0))
    value = value.otherwise(F.size(F.array_intersect(u, c)) / mine)
    return df.withColumn(name, F.coalesce(value, F.lit(0.0))).drop(u, c)


def distinct_shingles(fingerprint: str, hashes: int = HASHES) -> Column:
    """The estimated number of distinct shingles: exact below ``hashes``, else from the largest hash kept."""
    largest = F.element_at(F.col(fingerprint), -1).cast("double")
    share = (largest + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(fingerprint) < hashes, F.size(fingerprint).cast("double")).otherwise((hashes - 1) / share)


def merge_fingerprints(df: DataFrame, keys: list[str], fingerprint: str, hashes: int = HASHES) -> DataFrame:
    """The fingerprint of the union of all rows with the same keys: keys and ``fingerprint``.

    Null fingerprints count as empty; null keys are a group of their own. Rows of a key are dealt to
    groups of about FAN_IN at random and merged, level by level, so that one key may hold any share of
    the rows.
    """
    rows = df.select(*keys, F.coalesce(fingerprint, F.array().cast("array<bigint>")).alias("fingerprint"))
    rows = stored(rows.withColumn("_part", F.monotonically_increasing_id()), "fingerprints")
    largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while True:
        groups = max(1, math.ceil(largest / FAN_IN))
        merged = rows.groupBy(*keys, F.pmod(F.xxhash64("_part", F.lit(groups)), F.lit(groups)).alias("_part"))
        merged = merged.agg(F.array_distinct(F.flatten(F.collect_list("fingerprint"))).alias("fingerprint"))
        rows = merged.withColumn("fingerprint", F.slice(F.sort_array("fingerprint"), 1, hashes))
        if groups == 1:
            return rows.select(*keys, "fingerprint")
        largest = groups


def with_next_document(docs: DataFrame, columns: list[str], derive=None) -> DataFrame:
    """Add ``next_<column>`` from the next row in descending doc_id order; after the last: the first.

    Rows without a doc_id come last. Rows that repeat a doc_id are ordered by a hash of their text; those
    that are equal in both may stand in any order. A single row follows itself. ``derive``, if given, adds
    columns after the rows were dealt to buckets and before the next row is looked up.

    A bucket is a range of doc_ids of at most BUCKET_ROWS rows by count, whatever the ids: fuller ranges are cut
    at their own quantiles until none is left, a repeated doc_id by the hash of its texts, and equal rows at
    random. Only the first row of each bucket is sent to all tasks, so that it can stand behind the last row
    of the bucket before, too. The texts move once.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("_hash", F.xxhash64("text")).withColumn("_bucket", F.array().cast("array<bigint>"))
    keys = stored(docs.select("doc_id", "_hash", "_bucket"), "keys")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = min(BUCKET_ROWS, max(LEAST_ROWS, keys.count() // (2 * parts)))
    while True:
        ranges = stored(_ranges(keys), "ranges")
        full = ranges.filter((F.col("n") > limit) & F.col("divisible"))
        if full.isEmpty():
            break
        cuts = stored(_cuts(keys, full, limit), "cuts")
        docs = _cut(docs, cuts)
        keys = stored(_cut(keys, cuts), "keys")
    copies = ranges.filter(F.col("n") > limit).select("_bucket", F.ceil(2 * F.col("n") / limit).alias("_pieces"))
    docs = docs.join(F.broadcast(copies), "_bucket", "left")
    piece = F.floor(F.rand(0) * F.coalesce("_pieces", F.lit(1)))
    docs = docs.withColumn("_bucket", F.concat("_bucket", F.array(piece))).drop("_pieces")
    heads = ranges.join(F.broadcast(copies), "_bucket", "left")
    heads = heads.select("_bucket", "head", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)).alias("_piece"))
    heads = heads.select(F.concat("_bucket", F.array("_piece")).alias("_bucket"), "head")
    before = F.lag("_bucket").over(Window.orderBy(F.desc("_bucket")))
    last = F.min("_bucket").over(Window.partitionBy(F.lit(0)))
    guests = heads.select("head.doc_id", "head._hash", F.coalesce(before, last).alias("_to"))
    guests = stored(guests, "heads")

    def same(other: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(other["doc_id"]) & docs["_hash"].eqNullSafe(other["_hash"])

    wanted = guests.select("doc_id", "_hash").distinct()
    visiting = docs.join(F.broadcast(wanted), same(wanted), "left_semi").dropDuplicates(["doc_id", "_hash"])
    visiting = visiting.join(F.broadcast(guests), same(guests)).select(
        *(docs[c] for c in docs.columns if c != "_bucket"), F.col("_to").alias("_bucket")
    )
    both = docs.withColumn("_guest", F.lit(0)).unionByName(visiting.withColumn("_guest", F.lit(1)))
    both = both.repartition(max(1, guests.count() // 2), "_bucket")
    if derive:
        both = derive(both)
    window = Window.partitionBy("_bucket").orderBy(
        "_guest", F.col("doc_id").desc_nulls_last(), F.col("_hash").desc_nulls_last()
    )
    out = both.select("*", *(F.lead(c).over(window).alias(f"next_{c}") for c in columns))
    return out.filter("_guest = 0").drop("_hash", "_bucket", "_guest")


def _ranges(keys: DataFrame) -> DataFrame:
    """A row per bucket: ``n`` rows, the first of them (``head``), by what it can be cut, and from where."""
    order = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("_hash"))
    ranges = keys.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(order).alias("head"),
        F.count("doc_id").alias("ids"),
        F.struct(F.min("doc_id").cast("long").alias("least"), F.max("doc_id").cast("long").alias("most")).alias("id"),
        F.struct(F.min("_hash").alias("least"), F.max("_hash").alias("most")).alias("hash"),
    )
    by_id = ((F.col("id.least") < F.col("id.most")) | F.col("ids").between(1, F.col("n") - 1)) & (F.col("ids") > 0)
    by_id = F.coalesce(by_id, F.lit(False))
    span = F.when(by_id, F.col("id")).otherwise(F.col("hash"))
    ranges = ranges.withColumn("by_id", by_id).withColumn("span", span)
    narrow = F.try_subtract("span.most", "span.least").isNotNull()  # else the doubles of the values themselves
    base = F.when(narrow, F.col("span.least")).otherwise(F.lit(0))
    divisible = F.col("by_id") | (F.col("hash.least") < F.col("hash.most"))
    return ranges.select("_bucket", "n", "head", "by_id", base.alias("base"), "span.most", divisible.alias("divisible"))


def _distance() -> Column:
    """How far a row is from the base of its bucket; null without a doc_id in a bucket that is cut by it."""
    return F.when(F.col("by_id"), F.col("doc_id").cast("long")).otherwise(F.col("_hash")) - F.col("base")


def _cuts(keys: DataFrame, full: DataFrame, limit: int) -> DataFrame:
    """Where to cut each full bucket: quantiles of the distances, and the largest, which always parts some rows.

    Of the quantiles as many are taken as make pieces of half the limit.
    """
    shares = [k / QUANTILES for k in range(QUANTILES)]
    inside = keys.join(F.broadcast(full.drop("head", "divisible")), "_bucket")
    inside = inside.withColumn("_distance", _distance()).groupBy("_bucket", "by_id", "base", "most", "n")
    some = inside.agg(F.percentile_approx("_distance", shares, 100 * QUANTILES).alias("cuts"))
    step = F.greatest(F.lit(1), F.floor(QUANTILES * limit / (2 * F.col("n"))))
    some = some.withColumn("cuts", F.filter("cuts", lambda c, k: k % step == 0))
    return some.select("_bucket", "by_id", "base", F.array_union("cuts", F.array(F.col("most") - F.col("base"))).alias("cuts"))


def _cut(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Append to each bucket the number of cuts up to the row, plus one; 0 without a doc_id or in buckets left whole."""
    rows = rows.join(F.broadcast(cuts), "_bucket", "left").withColumn("_distance", _distance())
    piece = F.size(F.filter("cuts", lambda c: c <= F.col("_distance"))) + 1
    piece = F.when(F.col("_distance").isNull(), F.lit(0)).otherwise(piece).cast("long")
    return rows.withColumn("_bucket", F.concat("_bucket", F.array(piece))).drop("by_id", "base", "cuts", "_distance")
