"""WARC archives of pages: one gzip member for each record, written and read by Spark tasks.

The reader goes through a file from front to back in constant memory for all but the record at hand: it
feeds chunks to an incremental decompressor, starts a new one behind each member, takes as much content
as Content-Length says, and checks the digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertline.llm.files import new_name, open_store

CHUNK_BYTES = 1 << 20
COMPRESSION_LEVEL = 4
BATCH_BYTES = 8 << 20

# Fixed values of the format.
VERSION = b"WARC/1.1"
LINE_END = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2000-01-01T00:00:00Z"
DIGESTS = ("md5", "sha1", "sha256", "sha512")

MANIFEST = "file string, records long, bytes long"
RECORDS = (
    "file string, record long, page_id long, url string, record_type string, refers_to long, "
    "payload_digest string, payload_bytes long, payload binary, record_id string, refers_to_id string, date string"
)


def first_copies(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add ``payload`` (the html in UTF-8; null: empty) and ``refers_to``.

    Of rows with equal payloads of at least ``min_bytes`` bytes, the smallest page_id is the one that the
    others refer to; its own ``refers_to`` is null, and so are those of smaller payloads. Rows that repeat
    both page_id and payload all count as that first one. A null page_id is never the smallest; where all
    are null, none refers to another. The smallest ids are combined before the shuffle by SHA-1 and length,
    so that a payload may fill any share of the rows.
    """
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    pages = pages.withColumn("payload", payload).drop("refers_to")
    pages = pages.withColumn("_key", F.concat_ws(" ", F.sha1("payload"), F.octet_length("payload")))
    counted = pages.filter(F.octet_length("payload") >= min_bytes)
    least = counted.groupBy("_key").agg(F.min("page_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    least = least.filter("_n > 1").drop("_n")
    pages = pages.join(least, "_key", "left")
    other = F.col("_least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_least"))
    return pages.withColumn("refers_to", F.when(other, F.col("_least"))).drop("_key", "_least")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write a record for each row of ``page_id``, ``url`` and ``html``; returns the manifest of the files.

    The first of equal payloads is a response with its payload, the others are revisits with headers only
    (see ``first_copies``). An empty table writes no file. Other columns are ignored. A task writes a
    file under a name of its own, and the manifest lists only files of tasks that succeeded.
    """
    rows = first_copies(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), min_bytes)
    rows = rows.select("page_id", F.col("url").cast("string").alias("url"), "payload", "refers_to")
    store = f"{folder}/archives"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_store(store)
        files.create_dir(path, recursive=True)
        name, out, records, size = new_name(TaskContext.get().partitionId(), ".warc.gz"), None, 0, 0
        try:
            for batch in batches:
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out = out or files.open_output_stream(f"{path}/{name}", compression=None)
                    member = _member(record_bytes(page_id, url, payload, refers_to))
                    out.write(member)
                    records, size = records + 1, size + len(member)
        finally:
            if out:
                out.close()
        if records:
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())],
                ["file", "records", "bytes"],
            )

    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(COMPRESSION_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def _page(fields: dict[str, str], name: str) -> int | None:
    """The page of a record identifier of this module; None for identifiers of any other form."""
    found = re.fullmatch(r"<?urn:page:(-?[0-9]{1,19})>?", fields.get(name, ""))
    page_id = int(found[1]) if found else None
    return page_id if page_id is not None and -(1 << 63) <= page_id < 1 << 63 else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, not yet compressed. A revisit has the full payload's digest and length, not its bytes."""
    revisit = refers_to is not None
    head = LINE_END.join((b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"", b""))
    block = head if revisit else head + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{_uri(page_id)}>",
        "WARC-Date": RECORD_DATE,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
        "WARC-Block-Digest": "sha1:" + digest(block),
        "WARC-Payload-Digest": "sha1:" + digest(payload),
        "X-Payload-Length": len(payload),
    }
    if url is not None:
        fields["WARC-Target-URI"] = "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url)
    if revisit:
        fields["WARC-Profile"] = REVISIT_PROFILE
        fields["WARC-Refers-To"] = f"<{_uri(refers_to)}>"
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields.items()), b"", b""]
    return LINE_END.join(lines) + block + LINE_END * 2


def read_members(stream) -> Iterator[bytearray]:
    """The content of each gzip member of an open file, decompressed chunk by chunk."""
    unpacker, content, data = None, bytearray(), b""
    while data or (data := stream.read(CHUNK_BYTES)):
        unpacker = unpacker or zlib.decompressobj(31)
        content += unpacker.decompress(data, CHUNK_BYTES)
        data = unpacker.unconsumed_tail
        if unpacker.eof:
            data = unpacker.unused_data
            yield content
            unpacker, content = None, bytearray()
    if unpacker is not None:
        content += unpacker.flush()
        if not unpacker.eof:
            raise ValueError("the archive ends inside a record")
        yield content


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Named fields by lower-case name; a line that begins with a blank goes on with the one before it."""
    fields: dict[str, str] = {}
    key = ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and key:
            fields[key] = f"{fields[key]} {text.strip()}".strip()
        else:
            key, _, value = text.partition(":")
            key = key.strip().lower()
            fields[key] = value.strip()
    return fields


def _check(stated: str | None, data: bytes, what: str) -> None:
    """Compare a ``label:value`` digest, if there is one and its algorithm is known, in base32 or hex."""
    label, _, value = (stated or "").partition(":")
    name = label.strip().lower().replace("-", "")
    if name not in DIGESTS or not value:
        return
    found = hashlib.new(name, data)
    if value.upper().rstrip("=") != base64.b32encode(found.digest()).decode().rstrip("=") and value.lower() != found.hexdigest():
        raise ValueError(f"a record's {what} digest is wrong")


def parse_record(member: bytes | bytearray) -> dict:
    """Fields, type and payload of one record of any writer; a wrong frame or digest is an error.

    Digests are optional and compared where they are given with an algorithm of DIGESTS; others are passed on.
    The payload of an HTTP message is what follows its header, of any other record the whole block. A segment
    (``WARC-Segment-Number``) has a part of a payload, so only its block is checked. A revisit has no payload;
    its digest is the stated one, its length the one that ``X-Payload-Length`` states (null: not stated).
    ``page_id`` and ``refers_to`` are null unless the identifiers are those of ``record_bytes``.
    """
    head, found, rest = bytes(member).partition(LINE_END * 2)
    lines = head.split(LINE_END)
    if not found or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(lines[1:])
    if not re.fullmatch("[0-9]+", fields.get("content-length", "")):
        raise ValueError("a record has no Content-Length")
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != LINE_END * 2:
        raise ValueError("a record's Content-Length is wrong")
    _check(fields.get("warc-block-digest"), block, "block")
    kind = fields.get("warc-type", "").lower()
    http = fields.get("content-type", "").lower().startswith("application/http")
    payload = block.partition(LINE_END * 2)[2] if http else block
    stated = fields.get("warc-payload-digest")
    if kind == "revisit":
        length = fields.get("x-payload-length", "")
        payload, length = None, int(length) if re.fullmatch("[0-9]{1,18}", length) else None
    else:
        length = len(payload)
        if "warc-segment-number" not in fields:
            _check(stated, payload, "payload")
            stated = stated or "sha1:" + digest(payload)
    return {
        "page_id": _page(fields, "warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "record_type": kind or None,
        "refers_to": _page(fields, "warc-refers-to"),
        "payload_digest": stated.removeprefix("sha1:") if stated else None,
        "payload_bytes": length,
        "payload": payload,
        "record_id": fields.get("warc-record-id"),
        "refers_to_id": fields.get("warc-refers-to"),
        "date": fields.get("warc-date"),
    }


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """All records of the archives in the manifest, a file after the other in each task.

    The files lie in ``archives`` of the folder and may be of any writer that compresses each record by itself.
    Returns file, record (its number in the file), page_id, url, record_type, refers_to, payload_digest (without
    the label "sha1:"), payload_bytes, payload (null for a revisit), record_id, refers_to_id and date. Records of
    every type are rows (see ``parse_record``). A file with fewer or more records than the manifest says is an
    error; a manifest with null ``records`` does not say.
    """
    store = f"{folder}/archives"
    parts = max(1, manifest.count())
    schema = "file string, record long, " + RECORDS.split("record long, ")[1]
    fields = pa.schema(
        [
            ("file", pa.string()),
            ("record", pa.int64()),
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload_digest", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload", pa.binary()),
            ("record_id", pa.string()),
            ("refers_to_id", pa.string()),
            ("date", pa.string()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_store(store)
        for batch in batches:
            for name, records in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, size, n = [], 0, 0
                with files.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for member in read_members(stream):
                        rows.append({"file": name, "record": n, **parse_record(member)})
                        n, size = n + 1, size + len(member)
                        if size > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, fields)
                            rows, size = [], 0
                if records is not None and n != records:
                    raise ValueError(f"{name} has {n} records, not {records}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, fields)

    return manifest.select("file", "records").repartition(parts).mapInArrow(read, schema)
