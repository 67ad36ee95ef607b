"""Token ids in files of length-delimited binary records, with an offset index beside them.

A record is: length of the payload (8 bytes), masked CRC-32C of these 8 bytes (4), payload, masked CRC-32C
of the payload (4); all little-endian. The payload is 1 byte (0: no doc_id), the doc_id (8 bytes, signed),
1 byte for the width of an id (2 if all ids of the document are below 65536, else 4), and the ids
(unsigned). The index is a Parquet table with one row for each record: ``part``
(files in this order hold ascending doc_ids), ``file``, ``record``, ``doc_id``, ``offset``, ``length`` (of
the whole record) and ``n_tokens``. A task writes a file under a name of its own and hands its index rows
to Spark's writer, so files of attempts that failed are in no index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertline.llm.crc32c import MASK_DELTA, crc32c, crc32c_of_few, masked
from alertline.llm.files import new_name, open_store
from alertline.llm.tokens import encoder

INDEX = "part long, file string, record long, doc_id long, offset long, length long, n_tokens long"
RECORDS = "part long, record long, doc_id long, ids binary"
BUFFER_BYTES = 4 << 20

_HEAD = "<?qB"
_HEAD_BYTES = 10


def write_records(docs: DataFrame, folder: str, tokenizer: str, drops_spaces: bool, end_id: int) -> DataFrame:
    """Encode whole texts and write them under ``folder`` in ascending doc_id order; returns the index.

    Reads ``doc_id`` and ``text``. Each document's ids are followed by ``end_id``; a null or empty text is
    the end id alone. Rows without a doc_id come first; rows that repeat one are records of their own, in
    the order of their texts. An empty table makes an empty index. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    store = f"{folder}/records"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files, path = open_store(store)
        files.create_dir(path, recursive=True)
        name, out, offset, record = new_name(part, ".records"), None, 0, 0
        encode = encoder(tokenizer, drops_spaces).encode_column
        try:
            for batch in batches:
                for row, ids, bounds in encode(batch.column("text")):
                    n = len(bounds) - 1
                    doc_ids = batch.column("doc_id").slice(row, n)
                    texts = [np.append(x, np.uint32(end_id)) for x in np.split(ids, bounds[1:-1])]
                    framed = frame([payload(d, x) for d, x in zip(doc_ids.to_pylist(), texts, strict=True)])
                    out = out or files.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(b"".join(framed))
                    lengths = np.array([len(f) for f in framed], np.int64)
                    offsets = offset + np.cumsum(lengths) - lengths
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, part)),
                            pa.array([name] * n),
                            pa.array(np.arange(record, record + n)),
                            doc_ids,
                            pa.array(offsets),
                            pa.array(lengths),
                            pa.array([len(x) for x in texts], pa.int64()),
                        ],
                        ["part", "file", "record", "doc_id", "offset", "length", "n_tokens"],
                    )
                    offset, record = offset + int(lengths.sum()), record + n
        finally:
            if out:
                out.close()

    rows.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    """What a record holds."""
    narrow = ids.astype("<u2")
    width = 2 if (narrow == ids).all() else 4
    return struct.pack(_HEAD, doc_id is not None, doc_id or 0, width) + (
        narrow.tobytes() if width == 2 else ids.astype("<u4").tobytes()
    )


def parse(payload: bytes) -> tuple[int | None, bytes]:
    """The doc_id, and the ids of four bytes each."""
    has, doc_id, width = struct.unpack_from(_HEAD, payload)
    ids = payload[_HEAD_BYTES:]
    return doc_id if has else None, ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def frame(payloads: list[bytes]) -> list[bytes]:
    """Records of payloads."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    of_length = masked(crc32c(lengths)).astype("<u4")
    of_payload = masked(crc32c(payloads)).astype("<u4")
    return [
        b"".join((n, a.tobytes(), p, b.tobytes()))
        for n, a, p, b in zip(lengths, of_length, payloads, of_payload, strict=True)
    ]


def unframe(records: list[bytes]) -> list[bytes]:
    """Payloads of whole records; a wrong length or checksum is an error."""
    lengths = [r[:8] for r in records]
    payloads = [r[12:-4] for r in records]
    stated = np.array([struct.unpack("<I", r[8:12])[0] for r in records], np.uint32)
    of_payload = np.array([struct.unpack("<I", r[-4:])[0] for r in records], np.uint32)
    right = all(struct.unpack("<Q", n)[0] == len(p) for n, p in zip(lengths, payloads, strict=True))
    if not right or (masked(crc32c(lengths)) != stated).any() or (masked(crc32c(payloads)) != of_payload).any():
        raise ValueError("a record's length or checksum is wrong")
    return payloads


def _found(index: list[dict], records: list[bytes]) -> pa.RecordBatch:
    """Rows of records that lie where some index rows say."""
    parsed = [parse(p) for p in unframe(records)]
    return _batch([r["part"] for r in index], [r["record"] for r in index], parsed)


def _batch(parts: list[int], records: list[int] | range, rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(parts, pa.int64()),
            pa.array(records, pa.int64()),
            pa.array([d for d, _ in rows], pa.int64()),
            pa.array([x for _, x in rows], pa.binary()),
        ],
        ["part", "record", "doc_id", "ids"],
    )


def _check_head(head: bytes) -> None:
    """Trust a length only if its checksum is right."""
    crc = crc32c_of_few(head[:8])
    if ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF != struct.unpack("<I", head[8:12])[0]:
        raise ValueError("the checksum of a record's length is wrong")


def _stream(stream: pa.NativeFile) -> Iterator[list[bytes]]:
    """The records of an open file in order, some at a time."""
    some, size = [], 0
    while head := stream.read(12):
        if len(head) < 12:
            raise ValueError("a record's head is cut off")
        rest = struct.unpack("<Q", head[:8])[0] + 4
        _check_head(head)
        body = stream.read(rest)
        some.append(head + body)
        size += rest
        if size > BUFFER_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def _files(batches: Iterator[pa.RecordBatch], store: str) -> Iterator[tuple[int, int, list[tuple[int | None, bytes]]]]:
    """The records of files named by (part, file), from front to back: part, number of the first, (doc_id, ids)."""
    opened, path = open_store(store)
    for batch in batches:
        for part, name in zip(batch.column("part").to_pylist(), batch.column("file").to_pylist(), strict=True):
            first = 0
            with opened.open_input_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20) as stream:
                for some in _stream(stream):
                    yield part, first, [parse(p) for p in unframe(some)]
                    first += len(some)


def _named(spark: SparkSession, files: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(files, "part long, file string").repartition(max(1, len(files)))


def read_all(spark: SparkSession, folder: str, files: list[tuple[int, str]]) -> DataFrame:
    """Every record of the named files (part, file): part, record (its number in the file), doc_id, ids."""
    store = f"{folder}/records"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, first, rows in _files(batches, store):
            yield _batch([part] * len(rows), range(first, first + len(rows)), rows)

    return _named(spark, files).mapInArrow(read, RECORDS)


def read_at(index: DataFrame, folder: str) -> DataFrame:
    """The records of some index rows, in the order of these rows, by their offsets: for shuffled reads."""
    store = f"{folder}/records"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, path = open_store(store)
        name, file = None, None
        for batch in batches:
            rows, records, size = [], [], 0
            for row in batch.to_pylist():
                if row["file"] != name:
                    if file is not None:
                        file.close()
                    name, file = row["file"], opened.open_input_file(f"{path}/{row['file']}")
                rows.append(row)
                records.append(file.read_at(row["length"], row["offset"]))
                size += row["length"]
                if size > BUFFER_BYTES:
                    yield _found(rows, records)
                    rows, records, size = [], [], 0
            if rows:
                yield _found(rows, records)

    return index.select("part", "file", "record", "offset", "length").mapInArrow(read, RECORDS)


def document_spans(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all earlier documents: those in earlier files (one number for each file,
    from the index) and those in front of it in its own file.
    """
    totals = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before = np.cumsum([0, *(t["n"] for t in totals)]).tolist()
    base = {t["part"]: b for t, b in zip(totals, before[:-1], strict=True)}
    store = f"{folder}/records"

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for part, first, rows in _files(batches, store):
            start = base[part] if first == 0 else start
            lengths = [len(x) // 4 for _, x in rows]
            starts = start + np.cumsum(lengths) - lengths
            start += sum(lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _ in rows], pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(x) for _, x in rows], pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    files = [(t["part"], t["file"]) for t in totals]
    return _named(spark, files).mapInArrow(spans, "doc_id long, start long, n_tokens long, ids_crc32 long")
