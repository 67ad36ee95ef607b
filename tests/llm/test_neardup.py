import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from alertline.llm import neardup
from alertline.llm.components import components
from alertline.llm.neardup import drop_near_duplicates, near_duplicates


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(rows[k][0])
    out = []
    for k, (doc_id, _) in enumerate(rows):
        known = [i for i in groups[root(k)] if i is not None]
        least = min(known) if known else None
        out.append((doc_id, len(sets[k]), least if sets[k] else doc_id, doc_id == (least if sets[k] else doc_id)))
    return sorted(out, key=repr)


def planted(seed, groups, copies, edits):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(edits)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**9), " ".join(text)))
    return rows


@pytest.mark.parametrize("block_rows", [256, 7])
def test_equals_all_pairs(spark, block_rows):
    rows = planted(1, 6, 25, 8) + planted(2, 40, 2, 9)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=block_rows)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_odd_documents(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = near_duplicates(odd_documents)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert near_duplicates(no_documents).count() == 0
    kept = drop_near_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({r[0] for r in brute(rows) if r[3] and r[0] is not None})
    # a copy without a doc_id goes as other copies do; the null text is no copy
    assert [r.text for r in kept.filter("doc_id IS NULL").collect()] == [None]


def test_keys_find_every_pair_within_the_distance():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, neardup.SYMBOLS, dtype=np.uint16)
        b = a.copy()
        at = rng.choice(neardup.SYMBOLS, neardup.MAX_DISTANCE, replace=False)
        b[at] ^= rng.integers(1, 1 << 16, len(at), dtype=np.uint16)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], ["node", "signature"]
        )
        one, two = next(neardup._keys([batch])).column("keys").to_pylist()
        assert set(one) & set(two)


def test_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(0, 300)] + [(1000, k) for k in range(1001, 1100)]
    links += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    expected = sorted((x, root(x)) for x in list(parent))
    assert sorted(map(tuple, got)) == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_equal_copies_of_hot_texts(spark):
    text = " ".join(f"w{k}" for k in range(60))
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    got = near_duplicates(copies).groupBy("component_id", "n_shingles").count().collect()
    assert [tuple(r) for r in got] == [(0, 56, 3000)]


def pairs_between(seed, pairs, low, high):
    """Pairs of texts of 300 words, with some words changed, whose resemblance is in [low, high)."""
    rng = random.Random(seed)
    rows = []
    while len(rows) < 2 * pairs:
        base = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        text = list(base)
        for at in rng.sample(range(300), rng.randrange(4, 16)):
            text[at] = f"x{rng.randrange(10**9)}"
        a, b = shingle_set(" ".join(base)), shingle_set(" ".join(text))
        if low <= len(a & b) / len(a | b) < high:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(text))]
    return rows


def test_pipeline_stage_drops_pairs_from_080(spark):
    near, far = pairs_between(11, 600, 0.80, 0.85), pairs_between(12, 40, 0.70, 0.80)
    rows = near + [(10_000 + d, text) for d, text in far]
    sets = {d: shingle_set(text) for d, text in rows}
    gone = {b for a, b in zip(sorted(sets)[::2], sorted(sets)[1::2]) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(gone) == 600
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(d, text, "en", "s", len(text)) for d, text in rows], schema)
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == sorted(set(sets) - gone)


@pytest.mark.parametrize("percent", [95, 85, 84, 80, 78])
def test_layout_follows_the_threshold(percent):
    import pyarrow as pa

    chunks = neardup.chunks_for(percent)
    assert neardup.miss_rate(percent, chunks) <= neardup.MAX_MISS_RATE
    rng = np.random.default_rng(percent)
    for _ in range(100):
        a = rng.integers(0, 1 << 16, neardup.SYMBOLS, dtype=np.uint16)
        b = a.copy()
        at = rng.choice(neardup.SYMBOLS, 2 * chunks - 1, replace=False)
        b[at] ^= rng.integers(1, 1 << 16, len(at), dtype=np.uint16)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], ["node", "signature"]
        )
        one, two = next(neardup._keys([batch], chunks)).column("keys").to_pylist()
        assert set(one) & set(two)


def test_layout_refuses_thresholds_it_would_miss():
    for percent in (77, 50):
        with pytest.raises(ValueError):
            neardup.chunks_for(percent)


def test_different_texts_under_one_doc_id_are_judged_each_for_itself(spark):
    a, b, c = (" ".join(f"{name}{k}" for k in range(60)) for name in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, b + " more"), (None, c + " more"), (None, None), (4, ""), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = drop_near_duplicates(docs, 80).collect()
    assert sorted((tuple(r) for r in kept), key=repr) == sorted([(1, a), (2, b), (3, c), (None, None), (4, ""), (4, "")], key=repr)
