import hashlib
import struct

import pytest
import xxhash
from conftest import TINY
from pyspark.sql import functions as F

from alertline.llm import fingerprints
from alertline.llm.fingerprints import (
    HASHES,
    distinct_shingles,
    merge_fingerprints,
    with_containment,
    with_fingerprint,
    with_next_document,
    with_resemblance,
)
from alertline.llm.queries import QUERIES


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
    return signed(h)


def shingles(text):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in text.lower().split()]
    if len(words) >= 5:
        return {chained(words[i : i + 5]) for i in range(len(words) - 4)}
    if not words:
        return set()
    joined = "".join(f"{w & (1 << 64) - 1:X}" for w in words)
    return {signed(xxhash.xxh64_intdigest(joined.encode(), seed=42))}


def sketch(text, k=HASHES):
    return sorted(shingles(text))[:k]


def likeness(a, b, k=HASHES):
    union = sorted(set(a) | set(b))[:k]
    return 1.0 if not union else len(set(union) & set(a) & set(b)) / len(union)


def test_query_equals_brute_force(spark):
    docs = sorted(spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect(), reverse=True)
    got = {r.doc_id: r for r in QUERIES["op1_fingerprints"](spark, TINY).collect()}
    assert len(got) == len(docs)
    for k, (doc_id, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = got[doc_id]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = sketch(text), sketch(edited), sketch(following)
        assert row.fingerprint == "".join(f"{x & (1 << 64) - 1:016X}" for x in a)
        assert row.edited_fingerprint == "".join(f"{x & (1 << 64) - 1:016X}" for x in b)
        assert row.near_edited == pytest.approx(likeness(a, b))
        assert row.near_next == pytest.approx(likeness(a, c))


def test_odd_documents(spark, odd_documents, no_documents):
    docs = odd_documents.withColumn("text", F.coalesce("text", F.lit("")))
    prints = with_fingerprint(docs, "text", "fingerprint").collect()
    assert len(prints) == docs.count()
    for row in prints:
        assert row.fingerprint == sketch(row.text)
    rows = with_next_document(docs, ["text"]).collect()
    assert len(rows) == docs.count()
    ids = sorted({r.doc_id for r in rows if r.doc_id is not None}, reverse=True)
    text = {r.doc_id: r.text for r in rows if r.doc_id is not None}
    following = {(r.doc_id, r.next_text) for r in rows}
    for a, b in zip(ids, ids[1:]):
        assert (a, text[b]) in following
    lasts = [r.next_text for r in rows if r.doc_id is None]
    assert text[ids[0]] in lasts  # behind the last row stands the first
    assert with_next_document(no_documents, ["text"]).count() == 0


def test_two_sketches(spark):
    words = [f"w{k}" for k in range(3000)]
    rows = [(" ".join(words[:2000]), " ".join(words[1000:])), ("", ""), ("a b", ""), (" ".join(words), " ".join(words[:1500]))]
    df = spark.createDataFrame(rows, "a string, b string")
    df = with_fingerprint(with_fingerprint(df, "a", "x"), "b", "y")
    df = with_resemblance(df, "x", "y", "near")
    df = with_containment(df, "y", "x", "inside").withColumn("n", distinct_shingles("x"))
    got = df.select("near", "inside", "n").collect()
    assert got[0].near == pytest.approx(1 / 3, abs=0.12) and got[0].n == pytest.approx(1996, rel=0.25)
    assert tuple(got[1]) == (1.0, 1.0, 0.0)
    assert got[2].near == 0.0 and got[2].inside == 1.0 and got[2].n == 1.0
    assert got[3].inside == 1.0


def test_parts_merge_to_the_whole(spark):
    parts = [("k", " ".join(f"w{j}" for j in range(k, k + 30))) for k in range(700)] + [(None, "a b c"), ("e", None)]
    df = with_fingerprint(spark.createDataFrame(parts, "k string, text string"), "text", "fingerprint")
    got = {r.k: r.fingerprint for r in merge_fingerprints(df, ["k"], "fingerprint").collect()}
    assert got["k"] == sorted(set().union(*(shingles(t) for k, t in parts if k == "k")))[:HASHES]
    assert got[None] == sketch("a b c") and got["e"] == []


def test_buckets_stay_small(spark, monkeypatch):
    """Far and near ids, one id on a third of the rows, equal rows and ids without a value."""
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 100)
    ids = [k * k * k for k in range(1000)] + [2**62 + k for k in range(500)] + [-(2**62)] + [None] * 300
    rows = [(i, f"text {i} {k}") for k, i in enumerate(ids)] + [(7, f"seven {k}") for k in range(900)] + [(9, "same")] * 600
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}

    def derive(df):
        counts = df.filter("_guest = 0").groupBy("_bucket").count()
        seen["largest"] = counts.agg(F.max("count")).first()[0]
        return df

    got = with_next_document(docs, ["doc_id", "text"], derive=derive).collect()
    assert seen["largest"] <= 100
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == sorted((i is None, i or 0, t) for i, t in rows)
    # each row is the next of exactly one row, and the steps go down but for the one from the last to the first
    assert sorted((r.next_doc_id is None, r.next_doc_id or 0, r.next_text) for r in got) == sorted(
        (i is None, i or 0, t) for i, t in rows
    )
    order = sorted({i for i, _ in rows if i is not None}, reverse=True) + [None]
    place = {i: k for k, i in enumerate(order)}
    steps = sorted(place[r.next_doc_id] - place[r.doc_id] for r in got)
    assert steps[0] == -(len(order) - 1) and steps[1] >= 0 and steps[-1] == 1
