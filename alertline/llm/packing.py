"""Best-fit packing of documents into sequences, improved by a swap-based local search.

Rows are dealt at random to groups of bounded size. A group is packed by best fit, longest first. If
that took more sequences than the sum of lengths needs, moves, one-for-one and two-for-one exchanges
between underfull sequences follow: each must raise the sum of squared fills, so that full sequences get
fuller and the emptiest run empty. What lies in poorly filled sequences of all groups is then pooled into
fewer groups and packed again.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertline.llm.tokens import encoder
from alertline.session import stored

CAPACITY = 2048
GROUP_ROWS = 20_000
LOOSE_SHARE = 0.95
MAX_ROUNDS = 12

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, drops_spaces: bool = False
) -> DataFrame:
    """Encode whole texts and cut those that are longer than a sequence.

    Reads ``doc_id`` and ``text``; returns ``doc_id``, ``piece`` (from 0), ``start`` (ids of the document
    before it), ``length`` and ``ids`` (little-endian unsigned 32-bit). A document's ids are followed by
    ``end_id``; a null or empty text is the end id alone. A longer document is cut into pieces of
    ``capacity`` ids, of which the first may be shorter. Rows that repeat a doc_id, or have none, are
    documents of their own. Other columns are ignored; an empty table has no pieces.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, drops_spaces).encode_column
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for row, ids, bounds in encode(batch.column("text")):
                rows = []
                for k, x in enumerate(np.split(ids, bounds[1:-1]), row):
                    with_end = np.append(x, np.uint32(end_id)).astype("<u4").tobytes()
                    rows += [(doc_ids[k], *piece) for piece in _cut(with_end, capacity)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def _cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, bytes]]:
    n = len(ids) // 4
    end = n % capacity or min(n, capacity)
    start, piece = 0, 0
    while start < n:
        yield piece, start, end - start, ids[4 * start : 4 * end]
        start, end, piece = end, end + capacity, piece + 1


def pack(
    rows: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, name: str = "packing"
) -> DataFrame:
    """Place rows of a given ``length`` into sequences: adds ``sequence_id`` and ``offset``.

    All columns are kept (``sequence_id`` and ``offset`` of the input are replaced), each row is placed
    once, offsets in a sequence are gapless from 0, and no sequence holds more than ``capacity``. Equal
    rows are rows of their own. A row without a length, or one that does not fit at all, is an error. An
    empty table gives an empty result.

    The rows are written to the shared folder with a number each, so that groups depend on nothing that
    could change when a task runs again. A group holds about ``group_rows`` rows, whatever the keys are.
    """
    rows = rows.drop("sequence_id", "offset", "_row", "_group")
    rest = stored(rows.withColumn("_row", F.monotonically_increasing_id()), name)
    wrong = rest.filter(f"length IS NULL OR length < 0 OR length > {capacity}").limit(1).count()
    if wrong:
        raise ValueError(f"every row needs a length from 0 to {capacity}")
    n, done = rest.count(), []
    for turn in range(MAX_ROUNDS):
        groups = max(1, math.ceil(n / group_rows))
        last = groups == 1 or turn == MAX_ROUNDS - 1
        packed = stored(_pack_groups(rest, capacity, groups, turn, last), name)
        done.append(packed.filter("NOT _loose"))
        rest = packed.filter("_loose").drop("sequence_id", "offset", "_loose")
        before, n = n, 0 if last else rest.count()
        if not n:
            break
        if n > before // 2:  # pooling once more would change little: place all that is left
            done.append(_pack_groups(rest, capacity, max(1, math.ceil(n / group_rows)), turn + 1, True))
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*rows.columns, "sequence_id", "offset")


def _pack_groups(rows: DataFrame, capacity: int, groups: int, turn: int, last: bool) -> DataFrame:
    columns = rows.columns
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(groups)).cast("long"))
    dealt = dealt.repartition("_group").sortWithinPartitions("_group", F.desc("length"), "_row")
    schema = rows.schema.add("sequence_id", "long").add("offset", "long").add("_loose", "boolean")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches):
            lengths = table.column("length").to_pylist()
            base = turn << 56 | table.column("_group")[0].as_py() << 24
            bins = pack_lengths(lengths, capacity)
            sequence, offset, loose = ([0] * len(lengths) for _ in range(3))
            for b, members in enumerate(bins):
                at = 0
                for k in members:
                    sequence[k], offset[k] = base | b, at
                    at += lengths[k]
                poor = not last and at < LOOSE_SHARE * capacity
                for k in members:
                    loose[k] = poor
            table = table.select(columns)
            for c, values, kind in (
                ("sequence_id", sequence, pa.int64()),
                ("offset", offset, pa.int64()),
                ("_loose", loose, pa.bool_()),
            ):
                table = table.append_column(c, pa.array(values, kind))
            yield from table.combine_chunks().to_batches()

    return dealt.mapInArrow(place, schema)


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each group, from batches sorted by group."""
    group, parts = None, []
    for batch in batches:
        values = batch.column("_group").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if parts and values[a] != group:
                yield pa.Table.from_batches(parts)
                parts = []
            group = values[a]
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in ``lengths`` (longest first), as few as best fit and the local search find."""
    room: list[int] = []
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    for k, n in enumerate(lengths):
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms &= ~(1 << r)
            bins[b].append(k)
            room[b] -= n
        else:
            b = len(bins)
            bins.append([k])
            room.append(capacity - n)
        by_room[room[b]].append(b)
        open_rooms |= 1 << room[b]
    least = -(-sum(lengths) // capacity)
    if len(bins) > least:
        bins = _search(bins, lengths, capacity, least)
    return [b for b in bins if b]


class _Partners:
    """The roomiest bin for each length that some bin holds (0: any bin), found again when it is asked for."""

    def __init__(self, bins: list[list[int]], room: list[int], lengths: list[int], capacity: int) -> None:
        self.bins, self.room, self.lengths = bins, room, lengths
        self.most = np.full(capacity + 1, -1, np.int64)  # of each length: a room that no bin with it exceeds
        self.heaps: dict[int, list[tuple[int, int]]] = {}
        self.there = [False] * len(bins)

    def put(self, b: int) -> None:
        """Offer a bin, or offer it anew after a change."""
        self.there[b] = True
        room = self.room[b]
        if room:
            for n in {0, *(self.lengths[k] for k in self.bins[b])}:
                heapq.heappush(self.heaps.setdefault(n, []), (-room, b))
                self.most[n] = max(self.most[n], room)

    def withdraw(self, b: int) -> None:
        self.there[b] = False

    def roomiest(self, n: int) -> int | None:
        """A bin with the most room of those that hold the length; ``most`` is right for it afterwards."""
        heap = self.heaps.get(n, [])
        while heap:
            room, b = heap[0]
            if self.there[b] and self.room[b] == -room and (not n or any(self.lengths[k] == n for k in self.bins[b])):
                self.most[n] = -room
                return b
            heapq.heappop(heap)
        self.most[n] = -1
        return None


def _search(bins: list[list[int]], lengths: list[int], capacity: int, least: int) -> list[list[int]]:
    """Move and exchange between underfull bins until nothing gains or ``least`` bins are left.

    The bins give in turn, the emptiest first, each to bins that are fuller: the exchange that brings over the
    most length is taken, as long as there is one. As the other bin is the fuller one, each raises the sum of
    squared fills, so the passes come to an end.
    """
    room = [capacity - sum(lengths[k] for k in b) for b in bins]
    used, better = len(bins), True
    while better and used > least:
        better = False
        partners = _Partners(bins, room, lengths, capacity)
        underfull = sorted((b for b in range(len(bins)) if bins[b] and room[b]), key=lambda b: -room[b])
        for b in underfull:
            partners.put(b)
        for poor in underfull:
            partners.withdraw(poor)
            while bins[poor] and _exchange(bins, room, lengths, partners, poor):
                better = True
            used -= not bins[poor]
            if used <= least:
                break
    return bins


def _exchange(bins: list[list[int]], room: list[int], lengths: list[int], partners: _Partners, poor: int) -> bool:
    """The move, one-for-one or two-for-one exchange that takes the most length out of a bin, if there is one."""
    first: dict[int, list[int]] = {}
    for k in bins[poor]:
        first.setdefault(lengths[k], []).append(k)
    given = {n: (ks[0],) for n, ks in first.items() if n}
    distinct = sorted(first)
    for i, n in enumerate(distinct):
        for m in distinct[i:]:
            if m != n or len(first[n]) > 1:
                given.setdefault(n + m, (first[n][0], first[m][0] if m != n else first[n][1]))
    sums = np.array(sorted(given), np.int64)
    if not len(sums):  # only empty rows are left, and they fit anywhere
        rich = partners.roomiest(0)
        if rich is None:
            return False
        bins[rich] += bins[poor]
        bins[poor] = []
        return True
    taken = np.arange(len(partners.most))
    while True:
        at = np.searchsorted(sums, np.where(partners.most >= 0, taken + partners.most, 0), side="right") - 1
        gains = np.where(at >= 0, sums[at] - taken, 0)
        n = int(gains.argmax())
        if gains[n] <= 0:
            return False
        rich = partners.roomiest(n)
        if rich is not None and n + room[rich] >= n + gains[n]:
            break  # the stated room was right
    give, gain = given[int(n + gains[n])], int(gains[n])
    take = next(((k,) for k in bins[rich] if lengths[k] == n), ()) if n else ()
    bins[poor] = [k for k in bins[poor] if k not in give] + list(take)
    bins[rich] = [k for k in bins[rich] if k not in take] + list(give)
    room[poor] += gain
    room[rich] -= gain
    partners.put(rich)
    return True


def sequences(pieces: DataFrame) -> DataFrame:
    """The ids of each sequence, joined in order of offset: ``sequence_id``, ``ids`` (binary).

    ``pieces`` has sequence_id, offset and ids; a sequence holds a bounded number of ids.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), ""))
    return pieces.groupBy("sequence_id").agg(ids.alias("ids"))
