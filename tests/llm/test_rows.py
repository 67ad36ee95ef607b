"""Operators that judge or write row by row: mixing, line rules, classifier, licences, archives."""

import base64
import hashlib
import math
import re
import zlib

import pytest
import regex
from conftest import FOLDER
from pyspark.sql import functions as F

from alertline.llm.licenses import TEMPLATES, scan_licenses
from alertline.llm.lines import clean_lines, quality_verdict
from alertline.llm.mixing import mix, repeat_taken, source_targets, taken
from alertline.llm.queries import QUERIES
from alertline.llm.rules import SENTENCE_ENDS, Rule, RuleModel, score_quality, train, tree_rules
from alertline.llm.text import keep_where
from alertline.llm.warc import parse_record, read_archives, read_members, record_bytes, write_archives


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mix_of_odd_documents(spark, odd_documents, no_documents):
    mixed = mix(odd_documents)
    rows = mixed.withColumn("taken", taken(mixed)).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert r["size"] == len(words(r.text)) and 0 <= r.times <= 2 and r.taken <= 2 * r["size"]
    again = {(r.doc_id, r.text, r.times) for r in mix(odd_documents).collect()}
    assert again == {(r.doc_id, r.text, r.times) for r in rows}
    repeated = repeat_taken(mixed)
    assert repeated.count() == sum(r.times for r in rows)
    assert set(repeated.columns) == set(odd_documents.columns) - {"size", "target"}
    assert mix(no_documents).count() == 0


def test_targets_stop_at_twice_the_source(spark):
    sizes = {"a": 1000, "b": 10, "c": 0, "d": 500, "é": 40, None: 300}
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    target = {r.source: r.target for r in got}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = dict(zip(order, [3, 1, 2] * 2))
    budget, active, stopped = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        left = budget - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in active) for s in active}
        above = {s for s in active if share[s] >= 2 * sizes[s]}
        if not above:
            break
        stopped |= {s: 2.0 * sizes[s] for s in above}
        active -= above
    assert target == pytest.approx(stopped | share)


def test_larger_targets_only_add(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source")
    less = {r.doc_id: r.times for r in mix(docs, 110).collect()}
    more = {r.doc_id: r.times for r in mix(docs, 150).collect()}
    assert all(more[k] >= less[k] for k in less)


def test_lines_of_odd_documents(spark, odd_documents, no_documents):
    rows = quality_verdict(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        w = words(r.text)
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)} if len(w) < 500 else set()
        assert r.n_repeat_words == len(hit)
        assert r.kept == (r.doc_id in (7, 8))
    assert quality_verdict(no_documents).count() == 0
    assert keep_where(quality_verdict(odd_documents), "kept").count() == 2


def test_lines_that_fail(spark):
    text = "A sentence that stays here.\nHome | News | About | Contact.\nno end of a sentence\nA sentence that stays here.\n"
    text += "BUY IT NOW OR NEVER.\nRead our Cookie Policy today.\n### $$$ a.\n\nAnother one, said \"he.\" And stays"
    row = clean_lines(spark.createDataFrame([(text,)], "text string")).first()
    assert row.cleaned == 'A sentence that stays here.\nAnother one, said "he." And stays'
    assert row.lost_share == pytest.approx(1 - len("".join(words(row.cleaned))) / len("".join(words(text))))
    assert not row.lines_kept


def test_rules_of_a_printed_tree():
    printed = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5, numClasses=2, numFeatures=2
  If (feature 0 <= 0.5)
   If (feature 1 <= 2.0E-4)
    Predict: 0.0
   Else (feature 1 > 2.0E-4)
    Predict: 1.0
  Else (feature 0 > 0.5)
   Predict: 1.0
"""
    got = {r.terms for r in tree_rules(printed, ["x", "y"])}
    low, high = ("x", False, 0.5), ("x", True, 0.5)
    assert got == {(low,), (high,), (low, ("y", False, 2e-4)), (low, ("y", True, 2e-4))}


def test_classifier_on_the_held_out_fold(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = QUERIES["op7_quality_classifier"](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    scored = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = [s for s, y in scored if y == 1], [s for s, y in scored if y == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.95


def statistics(text):
    """The statistics of a text, in plain Python."""
    text = text or ""
    w = words(text)
    n, chars = max(len(w), 1), len("".join(w))
    lines = [x for x in text.split("\n") if words(x)]

    def count(pattern):
        return len(regex.findall(pattern, text))

    return {
        "stat_words": math.log1p(len(w)),
        "stat_word_length": chars / n,
        "stat_symbols": count(r"[#*$%&<>@^~=+_\\/{}\[\]]") / n,
        "stat_separators": (text.count("|") + text.count("•")) / n,
        "stat_exclamations": text.count("!") / n,
        "stat_commas": text.count(",") / n,
        "stat_capitals": count(r"\p{Lu}") / max(chars, 1),
        "stat_digits": count(r"[0-9]") / n,
        "stat_distinct_words": len(set(w)) / n,
        "stat_repeated_words": sum(a == b for a, b in zip(w, w[1:])) / n,
        "stat_distinct_lines": len(set(lines)) / max(len(lines), 1),
        "stat_ended_lines": sum(x.rstrip(" ")[-1:] in SENTENCE_ENDS for x in lines) / max(len(lines), 1),
    }


def test_scores_equal_rules_evaluated_row_by_row(spark, odd_documents):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert len(model.rules) > 1 and any(len(r.terms) > 1 for r in model.rules)
    for rows in (score_quality(docs, model).collect(), score_quality(odd_documents, model).collect()):
        for r in rows:
            seen = statistics(r.text)
            total = model.intercept + sum(
                rule.weight
                for rule in model.rules
                if all((seen[name] > at) if above else (seen[name] <= at) for name, above, at in rule.terms)
            )
            assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_classifier_on_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (2, 1)], "doc_id long, quality int")
    model = train(odd_documents, labels)
    assert not model.rules  # one label only
    rows = score_quality(odd_documents, RuleModel(0.3, [Rule((("stat_words", False, 0.1),), -1.0)])).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.predicted == (0 if not words(r.text) else 1) for r in rows)
    assert score_quality(no_documents, model).count() == 0
    assert train(no_documents, labels).rules == []


def normal(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def held(text, template):
    def grams(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = grams(normal(template))
    return len(want & grams(normal(text))) >= 0.8 * len(want)


def test_licences_equal_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    expected = {(r.doc_id, k) for r in rows for k, t in TEMPLATES.items() if held(r.text, t)}
    got = {(r.doc_id, r.license) for r in QUERIES["op8_license_scan"](spark, FOLDER).collect()}
    assert got == expected and expected


def test_licences_in_odd_places(spark, odd_documents, no_documents):
    filler = " ".join(f"w{k}" for k in range(1000))
    rows, expected = [], set()
    for k, (name, text) in enumerate(sorted(TEMPLATES.items())):
        for j, cut in enumerate((0, 3, 17, 500, 999)):
            w = filler.split(" ")
            rows.append((100 * k + j, " ".join([*w[:cut], text.upper(), *w[cut:]])))
        edited = text.split(" ")
        edited[-1] += "x"
        rows.append((100 * k + 50, " ".join(edited)))
    expected = {(i, k) for i, text in rows for k, t in TEMPLATES.items() if held(text, t)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in scan_licenses(docs).collect()} == expected
    assert scan_licenses(odd_documents).count() == 0
    assert scan_licenses(no_documents).count() == 0
    with pytest.raises(ValueError):
        scan_licenses(docs, {"short": "all rights reserved"})


def test_archives_of_odd_pages(spark, tmp_path):
    rows = [(3, "u", "<p>x</p>", "c"), (1, None, "<p>x</p>", None), (2, "u\n\r v", None, "c"), (4, "é", "", "c"), (5, "u", "ü" * 3_000_000, "c")]
    rows += [(1, None, "<p>x</p>", None), (None, "u", "<p>x</p>", "c"), (None, "u", "only", "c"), (6, "u", "a\r\n\r\nWARC/1.1\r\n", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    folder = f"file://{tmp_path}/odd"
    records = read_archives(spark, folder, write_archives(pages, folder)).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records), key=repr)
    first = {"<p>x</p>": 1, "": 2}
    expected = []
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        least = first.get(html or "", page_id)
        refers = None if page_id == least else least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected.append((page_id, len(data), digest, "response" if refers is None else "revisit", refers))
    assert got == sorted(expected, key=repr)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in records)
    none = f"file://{tmp_path}/none"
    assert read_archives(spark, none, write_archives(pages.limit(0), none)).count() == 0


def test_broken_archives_are_errors():
    import gzip
    import io

    record = record_bytes(1, "u", b"payload", None)
    assert parse_record(record)["payload"] == b"payload"
    two = gzip.compress(record) + gzip.compress(record_bytes(2, None, b"", 1))
    assert [parse_record(m)["page_id"] for m in read_members(io.BytesIO(two))] == [1, 2]
    with pytest.raises(ValueError):
        list(read_members(io.BytesIO(two[:-9])))
    for broken in (record.replace(b"payload\r\n", b"paxload\r\n"), record[:-3], record.replace(b"Content-Length: 6", b"Content-Length: 5")):
        with pytest.raises(ValueError):
            parse_record(broken)


def foreign_record(kind, block, **fields):
    lines = [b"WARC/1.0", b"WARC-Type: " + kind, b"Content-Length: %d" % len(block)]
    lines += [f"{k.replace('_', '-')}: {v}".encode() for k, v in fields.items()]
    return b"\r\n".join([*lines, b"", b""]) + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    """Records of any type, without digests or with those of other algorithms, with identifiers of any form."""
    import gzip

    http, page = "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>x</p>"
    sha256 = "sha256:" + hashlib.sha256(b"<p>x</p>").hexdigest()
    uuid = "<urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>"
    members = [
        foreign_record(b"warcinfo", b"software: s\r\n", Content_Type="application/warc-fields"),
        foreign_record(b"response", page, Content_Type=http, WARC_Record_ID=uuid, WARC_Date="2020-01-01T00:00:00Z"),
        foreign_record(b"response", page, Content_Type=http, WARC_Payload_Digest=sha256, WARC_Target_URI="u\r\n v"),
        foreign_record(b"response", page, Content_Type=http, WARC_Payload_Digest="crc9:xx", WARC_Block_Digest="odd"),
        foreign_record(b"revisit", b"", WARC_Refers_To=uuid, WARC_Payload_Digest="sha1:ABC"),
        foreign_record(b"request", b"", Content_Type="application/http; msgtype=request", WARC_Record_ID="<urn:page:x>"),
        foreign_record(b"response", b"part", Content_Type=http, WARC_Segment_Number=1, WARC_Payload_Digest=sha256),
        foreign_record(b"resource", "ü".encode(), WARC_Record_ID=f"<urn:page:{1 << 70}>"),
    ]
    (tmp_path / "archives").mkdir()
    (tmp_path / "archives" / "a.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in members))
    manifest = spark.createDataFrame([("a.warc.gz", None)], "file string, records long")
    rows = sorted(read_archives(spark, f"file://{tmp_path}", manifest).collect(), key=lambda r: r.record)
    kinds = ["warcinfo", "response", "response", "response", "revisit", "request", "response", "resource"]
    assert [r.record_type for r in rows] == kinds
    assert [r.payload_bytes for r in rows] == [13, 8, 8, 8, None, 0, 0, 2]
    assert rows[1].payload_digest == base64.b32encode(hashlib.sha1(b"<p>x</p>").digest()).decode()
    assert [r.payload_digest for r in rows[2:5]] == [sha256, "crc9:xx", "ABC"]
    assert rows[1].record_id == rows[4].refers_to_id == uuid and rows[1].date == "2020-01-01T00:00:00Z"
    assert rows[2].url == "u v" and all(r.page_id is None and r.refers_to is None for r in rows)
    for broken in (members[2].replace(b"<p>x", b"<p>y"), members[0].replace(b"Content-Length", b"Length")):
        with pytest.raises(ValueError):
            parse_record(broken)
