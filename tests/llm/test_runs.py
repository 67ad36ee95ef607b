import hashlib
import re
import zlib

import pytest
from conftest import TINY
from hypothesis import given, settings
from hypothesis import strategies as st

from alertline.llm.queries import QUERIES
from alertline.llm.runs import find_runs, lyndon_lengths, runs_of


def brute(words, least=6, exponent=4):
    found = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length, stretch = j + q - i, words[i : j + q]
            if j > i and length >= max(least, exponent * q):
                if not any(stretch[p:] == stretch[: length - p] for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30))
def test_lyndon_lengths(sequence):
    values = sorted(set(sequence))
    n = len(sequence)
    smaller = [next((j for j in range(i + 1, n) if sequence[j:] < sequence[i:]), n) - i for i in range(n)]
    assert lyndon_lengths([values.index(x) for x in sequence]) == smaller


PERIODS = st.lists(st.tuples(st.text(alphabet="abc", min_size=1, max_size=5), st.integers(1, 7)), max_size=5)
SEQUENCES = st.lists(PERIODS.map(lambda parts: list("".join(p * k for p, k in parts))), max_size=4)


@settings(max_examples=300, deadline=None)
@given(SEQUENCES, st.sampled_from([(6, 4), (2, 2), (6, 3)]))
def test_runs_equal_brute_force(sequences, rule):
    assert [[tuple(r) for r in rows.tolist()] for rows in runs_of(sequences, *rule)] == [brute(s, *rule) for s in sequences]


def rows_of(doc_id, text):
    """The contract, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    # brute force is cubic; longer texts are held against the tested function over whole texts
    runs = brute(words) if n < 800 else [tuple(r) for r in runs_of([words])[0].tolist()]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    milli = best[1] * 1000 // best[2] if runs else None
    texts = "".join(f"{s},{n},{q}\n" for s, n, q in runs), collapsed(words, runs)
    return (len(runs), *best, milli, *(hashlib.sha256(t.encode()).hexdigest() for t in texts))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, TINY).collect()}
    assert got == {doc_id: rows_of(doc_id, text) for doc_id, text in docs}
    assert sum(r[0] > 0 for r in got.values()) > 5


def test_odd_documents(spark, odd_documents, no_documents):
    more = odd_documents.limit(1).selectExpr("* except (doc_id, text)", "20L AS doc_id", "repeat('la ', 5000) AS text")
    odd = odd_documents.unionByName(more).withColumnRenamed("score", "Runs")
    rows = find_runs(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        expected = [(0, 5000, 1)] if r.doc_id == 20 else []
        assert [tuple(x) for x in r.runs] == expected and r.n_words == len(words)
        assert r.collapsed == collapsed(words, expected) and r.target == "x"
    assert find_runs(no_documents).count() == 0
    with pytest.raises(ValueError):
        find_runs(no_documents, exponent=1)
