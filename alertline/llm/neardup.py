"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has SYMBOLS MinHash values of 16 bits, cut into chunks of equal size. If two signatures differ
in at most 2 * chunks - 1 symbols, some chunk differs in at most one symbol, so leaving out each symbol of a
chunk in turn gives the two at least one equal key. The join on the keys therefore finds every pair within
that distance. The number of chunks follows from the threshold: two sets with a resemblance of 0.85 differ in
9 of 60 symbols on average and in more than 23 (12 chunks) in about two pairs of a million; at 0.80 it takes
15 chunks, and two pairs of ten million differ in more than 29.

Equal sets are one node from the start. Rows that share a key are never paired: each hangs on the
smallest of its key, the components of that are candidate groups, and within a group blocks of bounded
size are compared with each other, first by signature distance, then by the full shingle sets. A pair of
blocks returns a spanning forest of its links only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertline.llm.components import components
from alertline.llm.text import mix, shingle_sets, text_chunks, word_hashes
from alertline.session import stored

CHUNKS = 12
CHUNK_SYMBOLS = 5
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
MAX_DISTANCE = 2 * CHUNKS - 1
MAX_MISS_RATE = 2.5e-6
BLOCK_ROWS = 256
THRESHOLD_PERCENT = 85

_U = np.uint64
_FACTORS = mix(np.arange(1, SYMBOLS + 1, dtype=_U)) | _U(1)


def miss_rate(threshold_percent: int, chunks: int) -> float:
    """The share of pairs with a resemblance of the threshold that differ in more symbols than ``chunks`` serve."""
    p = 1 - threshold_percent / 100
    over = range(2 * chunks, SYMBOLS + 1)
    return sum(math.comb(SYMBOLS, k) * p**k * (1 - p) ** (SYMBOLS - k) for k in over)


def chunks_for(threshold_percent: int) -> int:
    """The least number of chunks that misses MAX_MISS_RATE of the pairs at the threshold, or fewer.

    Chunks have five or four symbols: keys of more do not fit in 64 bits, and keys of fewer meet by chance.
    """
    for size in (CHUNK_SYMBOLS, CHUNK_SYMBOLS - 1):
        if miss_rate(threshold_percent, SYMBOLS // size) <= MAX_MISS_RATE:
            return SYMBOLS // size
    raise ValueError(f"signatures of {SYMBOLS} symbols cannot find the pairs at a threshold of {threshold_percent} percent")


def near_duplicates(
    docs: DataFrame, threshold_percent: int = THRESHOLD_PERCENT, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Link documents whose sets of 5-word shingles have 100 * intersection >= threshold * union.

    Reads ``doc_id`` and ``text`` and returns ``doc_id``, ``n_shingles`` (size of the set),
    ``component_id`` (smallest doc_id reachable over links) and ``kept`` (doc_id = component_id), one
    row for each row. A-Z are lower-cased. Fewer than five words are one shingle; a null or empty text,
    or one without words, has an empty set and is linked with nothing: its component is its own doc_id.
    Rows that repeat a doc_id are rows of their own. A null doc_id never is a component's smallest; where
    all are null, component_id is null and the row is kept. Other columns are ignored. An empty table
    gives an empty result.

    The MinHash part finds all pairs under its signature distance, which follows from the threshold (see the
    module; a threshold below 78 raises ValueError); every link is confirmed on full sets, by 64-bit hashes of
    the shingles.
    """
    chunks = chunks_for(threshold_percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(docs.mapInArrow(_sign, "doc_id long, n_shingles long, node long, signature binary"), "signed")
    nodes = stored(
        signed.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("doc_id").alias("least"), F.max("signature").alias("signature")),
        "nodes",
    )
    candidates = components(_star_links(nodes, chunks), "candidates")
    close = _block_links(nodes.join(candidates, "node"), "signature", _signature_links(2 * chunks - 1), block_rows)
    close = components(close, "close")
    texts = close.join(nodes, "node").select("node", "component", F.col("least").alias("doc_id"))
    sets = _sets_of(docs, texts)
    links = _block_links(sets, "shingles", _set_links(threshold_percent), block_rows)
    linked = components(links, "linked")
    labels = nodes.select("node", "least").join(linked, "node", "left")
    labels = labels.withColumn("component", F.coalesce("component", "node"))
    smallest = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = labels.join(smallest, "component").select("node", "component_id")
    out = signed.select("doc_id", "n_shingles", "node").join(labels, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def drop_near_duplicates(docs: DataFrame, threshold_percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of ``near_duplicates``, with all its columns.

    Rows are judged by number, whatever their doc_id: of a group the row with the smallest doc_id stays (rows
    without one come last, equal ones by number), so different texts under one doc_id are judged each for itself.
    Rows without words are groups of their own and all stay. Columns named ``_row`` are lost.
    """
    rows = stored(docs.drop("_row").withColumn("_row", F.monotonically_increasing_id()), "rows")
    named = rows.select(F.col("_row").alias("doc_id"), "text")
    groups = near_duplicates(named, threshold_percent).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    first = groups.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order)["_row"].alias("_row"))
    return rows.join(first.select("_row"), "_row", "left_semi").drop("_row")


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    for row, data, offsets in text_chunks(batch.column("text")):
        yield row, shingle_sets(*word_hashes(data, offsets))


def _node(shingles: np.ndarray) -> int | None:
    """One number for a set: equal sets are one node."""
    if not len(shingles):
        return None
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SYMBOLS 16-bit MinHash values for each non-empty set."""
    values = np.concatenate(sets) if sets else np.empty(0, _U)
    starts = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for k, factor in enumerate(_FACTORS if len(sets) else ()):
        least = np.minimum.reduceat(values * factor ^ (values >> _U(31)), starts)
        out[:, k] = (mix(least) >> _U(48)).astype(np.uint16)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, sets in _sets(batch):
            full = [s for s in sets if len(s)]
            signed = iter(signatures(full))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(row, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_node(s) for s in sets], pa.int64()),
                    pa.array([next(signed).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "node", "signature"],
            )


def _keys(batches: Iterator[pa.RecordBatch], chunks: int = CHUNKS) -> Iterator[pa.RecordBatch]:
    """The keys of each signature: every chunk without each of its symbols in turn."""
    size = SYMBOLS // chunks
    for batch in batches:
        if not batch.num_rows:
            continue
        symbols = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16)
        symbols = symbols.reshape(batch.num_rows, chunks, size).astype(_U)
        keys = np.empty((batch.num_rows, chunks, size), _U)
        for left_out in range(size):
            packed = np.zeros((batch.num_rows, chunks), _U)
            for k in range(size):
                if k != left_out:
                    packed = packed << _U(16) | symbols[:, :, k]
            place = np.arange(chunks, dtype=_U) * _U(size) + _U(left_out)
            keys[:, :, left_out] = mix(packed ^ mix(place + _U(1)))
        flat = keys.reshape(-1).view(np.int64)
        offsets = np.arange(0, len(flat) + 1, SYMBOLS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["node", "keys"]
        )


def _star_links(nodes: DataFrame, chunks: int) -> DataFrame:
    """Hang each node on the smallest node with the same key."""
    signed = nodes.select("node", "signature")
    keyed = signed.mapInArrow(lambda batches: _keys(batches, chunks), "node long, keys array<long>")
    keyed = keyed.select("node", F.explode("keys").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(heads.drop("n"), "key").select(F.col("node").alias("a"), F.col("head").alias("b"))


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The full shingle sets of the wanted nodes, made anew from one text of each."""
    schema = "node long, shingles binary"
    texts = docs.filter("doc_id IS NOT NULL").join(wanted.select("doc_id").distinct(), "doc_id").select("text")
    # texts without a doc_id are few or none; those that stand for no wanted node fall out below
    unnamed = docs.filter("doc_id IS NULL").select("text")
    sets = texts.unionByName(unnamed).mapInArrow(_node_sets, schema)
    found = sets.join(wanted.select("node", "component"), "node")
    return found.groupBy("node", "component").agg(F.max("shingles").alias("shingles"))


def _node_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, sets in _sets(batch):
            full = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_node(s) for s in full], pa.int64()), pa.array([s.tobytes() for s in full], pa.binary())],
                ["node", "shingles"],
            )


def _block_links(rows: DataFrame, payload: str, find: Callable, block_rows: int) -> DataFrame:
    """Links inside groups: ``rows`` has node, component and a payload that ``find`` compares.

    A group of more than ``block_rows`` rows is cut into blocks; each pair of blocks is a cell of its own,
    so that no task holds more than two blocks.
    """
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.filter("n > 1").select("component", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    cells = rows.select("node", "component", F.col(payload).alias("payload")).join(sizes, "component")
    cells = cells.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "payload"
    )
    cells = cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            i, j, block, node, payloads = cell
            one = [k for k, b in enumerate(block) if b == i]
            two = one if i == j else [k for k, b in enumerate(block) if b == j]
            found = list(_forest(find(payloads, one, two), len(node)))
            if found:
                ends = [pa.array([node[f[e]] for f in found], pa.int64()) for e in (0, 1)]
                yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    return cells.mapInArrow(link, "a long, b long")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Gather the sorted rows of one cell at a time: (i, j, blocks, nodes, payloads)."""
    key, rows = None, ([], [], [])
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(6)]
        for component, i, j, block, node, payload in zip(*columns, strict=True):
            if key != (component, i, j):
                if key is not None and len(rows[1]) > 1:
                    yield key[1], key[2], *rows
                key, rows = (component, i, j), ([], [], [])
            rows[0].append(block)
            rows[1].append(node)
            rows[2].append(payload)
    if key is not None and len(rows[1]) > 1:
        yield key[1], key[2], *rows


def _forest(pairs: Iterator[tuple[int, int]], n: int) -> Iterator[tuple[int, int]]:
    """Those pairs that join two trees."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            yield a, b


def _signature_links(max_distance: int) -> Callable:
    def find(payloads: list[bytes], one: list[int], two: list[int]) -> Iterator[tuple[int, int]]:
        symbols = np.frombuffer(b"".join(payloads), np.uint16).reshape(len(payloads), SYMBOLS)
        right = symbols[two]
        for a in one:
            for k in np.flatnonzero((right != symbols[a]).sum(1) <= max_distance).tolist():
                yield a, two[k]

    return find


def _set_links(threshold_percent: int) -> Callable:
    def find(payloads: list[bytes], one: list[int], two: list[int]) -> Iterator[tuple[int, int]]:
        sizes = np.array([len(p) // 8 for p in payloads])
        common = _intersections(payloads, sizes)[np.ix_(one, two)]
        union = sizes[one][:, None] + sizes[two][None, :] - common
        for a, b in zip(*np.nonzero(100 * common >= threshold_percent * union), strict=True):
            if one[a] != two[b]:
                yield one[a], two[b]

    return find


def _intersections(payloads: list[bytes], sizes: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over the shingles that two sets or more hold."""
    values = np.frombuffer(b"".join(payloads), _U)
    rows = np.repeat(np.arange(len(payloads)), sizes)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    place = np.cumsum(count > 1) - 1
    rows, column = rows[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = np.zeros((len(payloads), len(payloads)), np.int64)
    for first in range(0, int((count > 1).sum()), columns):
        a, b = np.searchsorted(column, [first, first + columns])
        part = np.zeros((len(payloads), columns), np.float32)
        part[rows[a:b], column[a:b] - first] = 1
        total += np.rint(part @ part.T).astype(np.int64)
    return total
