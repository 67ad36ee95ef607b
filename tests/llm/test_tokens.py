import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import TINY
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from alertline.llm.crc32c import crc32c, crc32c_of_few, masked
from alertline.llm.packing import CAPACITY, pack, pack_lengths, sequences, token_pieces
from alertline.llm.queries import QUERIES, tokenizer
from alertline.llm.records import _stream, document_spans, frame, read_at, unframe, write_records
from alertline.llm.tokens import Encoder, cuts_at_spaces

FILES = {"byte_bpe_50k.json": False, "word_bpe_49k.json": True}


def whole(name):
    t = Tokenizer.from_file(tokenizer(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


PIECES = [Encoder(tokenizer(name), drops) for name, drops in FILES.items()]
WHOLE = [whole(name) for name in FILES]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab'sé1ÅΣ́世.!<|> \t\n \x1c\x85🙂", max_size=25), max_size=4))
def test_pieces_give_the_ids_of_whole_texts(texts):
    for pieces, plain in zip(PIECES, WHOLE):
        assert [x.tolist() for x in pieces.encode(texts)] == [plain(t) for t in texts]


def test_checksums():
    assert crc32c([b"123456789"])[0] == 0xE3069283  # the standard's check value
    parts = [bytes(range(256)) * k + b"x" * j for k in (0, 1, 2, 9) for j in (0, 1, 511)]
    alone = [crc32c([p])[0] for p in parts]
    assert crc32c(parts).tolist() == alone
    assert masked(np.array([0], np.uint32))[0] == 0xA282EAD8


@given(st.binary(max_size=40))
def test_checksums_of_few_bytes(data):
    assert crc32c_of_few(data) == crc32c([data])[0]


def test_files_with_other_rules_encode_whole_texts(tmp_path):
    assert [cuts_at_spaces(tokenizer(name)) for name in FILES] == list(FILES.values())
    rules = json.loads(open(tokenizer("byte_bpe_50k.json"), encoding="utf-8").read())
    rules["normalizer"] = {"type": "Lowercase"}
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(rules, file)
    texts = ["Some Words HERE", "", None, "Grüße  ÅÉ"]
    library = Tokenizer.from_file(path)
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for drops_spaces in (True, False):
        assert [x.tolist() for x in Encoder(path, drops_spaces).encode(texts)] == expected


def test_a_broken_length_is_an_error_before_it_is_trusted(tmp_path):
    first, second = frame([b"payload", b"more"])
    path = tmp_path / "broken"
    path.write_bytes(first + second[:3] + b"\xff" + second[4:])
    with pa.OSFile(str(path)) as file, pytest.raises(ValueError):
        list(_stream(file))


def test_broken_records_are_errors():
    record = frame([b"payload", b""])
    assert unframe(record) == [b"payload", b""]
    for k in range(len(record[0])):
        broken = record[0][:k] + bytes([record[0][k] ^ 1]) + record[0][k + 1 :]
        with pytest.raises(ValueError):
            unframe([broken])


def test_records_query_equals_brute_force(spark):
    docs = sorted(spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect())
    encode, start, expected = whole("word_bpe_49k.json"), 0, []
    for doc_id, text in docs:
        ids = [*encode(text), 2]
        expected.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op2_token_records"](spark, TINY).collect())) == expected


def test_odd_records_and_shuffled_reads(spark, odd_documents, no_documents, tmp_path):
    encode = whole("word_bpe_49k.json")
    folder = f"file://{tmp_path}/odd"
    index = write_records(odd_documents, folder, tokenizer("word_bpe_49k.json"), True, 2)
    rows = sorted(
        ((r.doc_id, r.text) for r in odd_documents.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    )
    start, expected = 0, []
    for doc_id, text in rows:
        ids = [*encode(text), 2]
        expected.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    spans = document_spans(spark, folder, index).orderBy("start").collect()
    assert [tuple(r) for r in spans] == expected
    some = index.orderBy("length").filter("doc_id != 3")
    read = read_at(some, folder).collect()
    assert sorted(zlib.crc32(r.ids) for r in read) == sorted(e[3] for e in expected if e[0] not in (3, None))
    empty = f"{folder}-empty"
    index = write_records(no_documents, empty, tokenizer("word_bpe_49k.json"), True, 2)
    assert document_spans(spark, empty, index).count() == 0


def check_packing(rows, docs):
    """Pieces are the documents' ids, cut as they must be, and lie in sequences without gaps."""
    encode, by_doc, bins = whole("byte_bpe_50k.json"), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    expected = {}
    for doc_id, text in docs:
        ids = [*encode(text), 0]
        first = len(ids) % CAPACITY or min(len(ids), CAPACITY)
        cuts = [0, *range(first, len(ids) + 1, CAPACITY)]
        pieces = [(k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        expected.setdefault(doc_id, []).extend(pieces)
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in expected.items()}
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= CAPACITY
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.01 * -(-total // CAPACITY) + 1


def test_packing_query(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()
    check_packing(QUERIES["op9_best_fit_packing"](spark, TINY).collect(), docs)


def test_odd_packing(spark, odd_documents, no_documents):
    from pyspark.sql import functions as F

    path = tokenizer("byte_bpe_50k.json")
    pieces = token_pieces(odd_documents, path, 0).withColumn("sequence_id", F.lit("clash"))
    packed = pack(pieces.withColumn("ids_crc32", F.crc32("ids"))).cache()
    check_packing(packed.collect(), [(r.doc_id, r.text) for r in odd_documents.collect()])
    joined = sequences(packed).collect()
    assert sum(len(r.ids) // 4 for r in joined) == packed.agg(F.sum("length")).first()[0]
    assert pack(token_pieces(no_documents, path, 0)).count() == 0
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(3000,)], "length long"))


def test_groups_are_pooled(spark):
    rows = spark.range(5000).selectExpr("id", "200 + pmod(xxhash64(id), 900) AS length")
    packed = pack(rows, group_rows=300).collect()
    assert len(packed) == 5000
    total = sum(r.length for r in packed)
    assert len({r.sequence_id for r in packed}) <= 1.03 * total / CAPACITY
    equal = pack(spark.range(3000).selectExpr("683 AS length"), group_rows=200).collect()
    assert len({r.sequence_id for r in equal}) <= 1510  # two in each


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60))
def test_local_search_keeps_all(lengths):
    lengths = sorted(lengths, reverse=True)
    bins = pack_lengths(lengths, 100)
    assert sorted(k for b in bins for k in b) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in b) <= 100 for b in bins)


def test_exchanges_empty_bins():
    # best fit takes 4 bins for 50+50, 33+33+33 and the like; three suffice
    lengths = sorted([55, 45, 40, 33, 33, 30, 27, 20, 17], reverse=True)
    assert len(pack_lengths(lengths, 100)) == 3
