import hashlib
from array import array

import pytest
from conftest import TINY
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from alertline.llm.bpe import RankBpe, decode_ids, encode_texts
from alertline.llm.queries import QUERIES, tokenizer

PATH = tokenizer("byte_bpe_50k.json")
RULES = RankBpe(PATH)
LIBRARY = Tokenizer.from_file(PATH)
SIGNS = "ab'sé1ÅΣ́世.!<|> \t\n \x1c\x85🙂　\xa0²Ⅷ"


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=SIGNS, max_size=20), max_size=3).map("<|endoftext|>".join))
def test_ids_are_the_librarys(text):
    ids = array("I", RULES.encode([text])[0])
    assert list(ids) == expected(text)
    assert RULES.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50300), max_size=20))
def test_decoding_any_ids(ids):
    assert RULES.decode(array("I", ids)) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdefgh", min_size=1, max_size=700))
def test_long_words_merge_as_short_ones(word):
    data = word.encode()
    assert list(RULES._long(data)) == list(RULES._short(data)) == expected(word)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdeé", min_size=6, max_size=6).filter(lambda w: len(w.encode()) == 8), max_size=30))
def test_words_merge_together_as_alone(words):
    data = [w.encode() for w in words]
    if data:
        assert RULES._together(data) == [RULES._short(d).tobytes() for d in data]


def test_forgotten_words_are_found_again(monkeypatch):
    monkeypatch.setattr("alertline.llm.bpe.REMEMBERED_WORDS", 5)
    rules = RankBpe(PATH)
    texts = [" ".join(f"{c}word{k}" for k in range(20)) for c in "abcabc"]
    for text in texts:
        assert list(array("I", rules.encode([text, None, ""])[0])) == expected(text)


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        RankBpe(tokenizer("word_bpe_49k.json"))


def test_query_equals_the_library(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_bpe"](spark, TINY).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = expected(text or "")
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x).hexdigest() for x in (array("I", ids).tobytes(), decoded.encode())]
        assert got[doc_id] == (len(ids), *digests)


def test_odd_documents(spark, odd_documents, no_documents):
    named = odd_documents.withColumnRenamed("score", "IDS")  # a column of the name is replaced
    rows = decode_ids(encode_texts(named, PATH), PATH).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert list(array("I", r.ids)) == expected(r.text or "")
        assert r.decoded == (r.text or "") and r.target == "x"
    assert encode_texts(no_documents, PATH).count() == 0
