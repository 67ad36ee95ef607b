"""Periodic runs of words: Lyndon arrays by Baier's grouping, and their roots extended into runs.

A run is a stretch of words with smallest period q (words q apart are equal) that no neighbour extends and
that holds at least ``max(MIN_WORDS, MIN_EXPONENT * q)`` words. By the runs theorem the longest Lyndon word
that begins at some place of a run, under the order of the words or under its reverse, is a root of the
run. Phase one of Baier's suffix sorter groups suffixes by just these Lyndon words: groups are refined from
the highest to the lowest, a suffix takes over the contexts of the higher suffixes after it, and its length
when its own group's turn comes is its entry of the Lyndon array. No suffix array is needed. How far a
root's period reaches to both sides are two longest common extensions, found for all roots of a batch at
once by descending powers of two over exact names of equal blocks.

The grouping runs on the stretches of a text that can hold a run: every window of ``WINDOW`` words inside a
run occurs several times in the text, so windows that do not are no part of any run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertline.llm.text import hash_ranges, mix, text_chunks, word_ranges

MIN_WORDS = 6
MIN_EXPONENT = 4
WINDOW = 3

RUNS = "array<struct<start: long, length: long, period: long>>"


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """The length of the longest Lyndon word at every place of a sequence of ranks (0, 1, ... without gaps).

    Suffixes whose group is done are unlinked, so that the suffixes left of one of the group's, seen while
    the group is unlinked from front to back, are those of lower groups: the ones that take over its context.
    """
    n = len(ranks)
    if not n:
        return []
    lengths = [0] * n
    left, right = list(range(-1, n)), list(range(1, n + 2))  # one place more, so that ends need no question
    group = list(ranks)
    members: list[list[int]] = [[] for _ in range(max(ranks) + 1)]
    for place, rank in enumerate(ranks):
        members[rank].append(place)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    current = len(members) - 1
    while current >= 0:
        heads: list[int] = []
        counts: list[int] = []
        last = -1
        for i in members[current]:
            if group[i] != current:
                continue
            j, r = left[i], right[i]
            lengths[i] = r - i
            left[r] = j
            if j >= 0:
                right[j] = r
                if j == last:
                    counts[-1] += 1
                else:
                    heads.append(j)
                    counts.append(1)
                    last = j
        members[current] = []
        for times in sorted(set(counts), reverse=True):  # more copies of the context make a higher group
            moved: dict[int, int] = {}
            for j, count in zip(heads, counts):
                if count != times:
                    continue
                old = group[j]
                new = moved.get(old)
                if new is None:
                    new = moved[old] = len(members)
                    up = above[old]
                    members.append([])
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    if up < len(below):
                        below[up] = new
                members[new].append(j)
                group[j] = new
        current = below[current]
    return lengths


def _block_names(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """Level k names blocks of 2**k codes: equal names, equal blocks. No block crosses a negative code."""
    levels, width = [codes], 1
    while width * 2 <= longest:
        names = levels[-1]
        first, second = names[:-width], names[width:]
        whole = np.full(len(codes), -1, np.int64)
        inside = np.flatnonzero((first >= 0) & (second >= 0))
        key = first[inside] * (int(names.max()) + 1) + second[inside]
        whole[inside] = np.unique(key, return_inverse=True)[1]
        levels.append(whole)
        width *= 2
    return levels


def _extensions(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, backward: bool) -> np.ndarray:
    """For each pair of places, how many codes from there on (or in front of there) are equal."""
    n, total = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names, step = levels[k], 1 << k
        while True:  # at most a few times a level, as the higher levels took what they could
            x, y = (a - total - step, b - total - step) if backward else (a + total, b + total)
            inside = (x >= 0) & (y >= 0) & (x < n) & (y < n)
            same = np.zeros(len(a), bool)
            at = np.flatnonzero(inside)
            same[at] = (names[x[at]] == names[y[at]]) & (names[x[at]] >= 0)
            if not same.any():
                break
            total += same * step
    return total


def runs_of(sequences: list[list], least: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> list[np.ndarray]:
    """All runs of each sequence: rows (start, length, period), by start and then period."""
    numbers: dict = {}
    parts, places, roots, offset = [], [], [], 0
    bounds = [0]
    for sequence in sequences:
        codes = np.array([numbers.setdefault(x, len(numbers)) for x in sequence], np.int64)
        if len(codes):
            ranks = np.unique(codes, return_inverse=True)[1]
            for order in (ranks, ranks.max() - ranks):
                lengths = np.array(lyndon_lengths(order.tolist()), np.int64)
                fit = np.flatnonzero(lengths * exponent <= len(codes))
                places.append(fit + offset)
                roots.append(lengths[fit])
        parts += [codes, np.array([-1])]
        offset += len(codes) + 1
        bounds.append(offset)
    if not places or not sum(map(len, places)):
        return [np.empty((0, 3), np.int64) for _ in sequences]
    codes = np.concatenate(parts)
    at, period = np.concatenate(places), np.concatenate(roots)
    levels = _block_names(codes, max(len(p) for p in parts))
    forward = _extensions(levels, at, at + period, False)
    backward = _extensions(levels, at, at + period, True)
    start, length = at - backward, backward + period + forward
    long = (length >= least) & (length >= exponent * period)
    found = np.unique(np.stack([start[long], length[long], period[long]], axis=1), axis=0)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    cut = np.searchsorted(found[:, 0], bounds)
    out = [found[a:b].copy() for a, b in zip(cut[:-1], cut[1:])]
    for rows, first in zip(out, bounds):
        rows[:, 0] -= first
    return out


def times_in_run(least: int, exponent: int, window: int = WINDOW) -> int:
    """How often each window inside a run occurs in it at least."""
    periods = range(1, max(least, window) + 1)
    return min((max(least, exponent * q) - window + 1) // q for q in periods)


def candidate_stretches(hashes: np.ndarray, bounds: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """Stretches (row, first word, end) of texts, given by hashes of their words, that may hold runs.

    Two words of equal hash only make more stretches. A window counts within its own text.
    """
    n, times = len(hashes), times_in_run(least, exponent)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    good = np.ones(n, bool)
    if times > 1:
        width = max(0, n - WINDOW + 1)
        key = mix(row[:width].astype(np.uint64) + np.uint64(1))
        for j in range(WINDOW):
            key = mix(key + hashes[j : j + width])
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        inside = row[:width] == row[WINDOW - 1 :] if width else np.empty(0, bool)
        frequent = np.flatnonzero((count[inverse] >= times) & inside)
        covered = np.zeros(n + 1, np.int64)
        np.add.at(covered, frequent, 1)
        np.add.at(covered, frequent + WINDOW, -1)
        good = np.cumsum(covered[:n]) > 0
        # two neighbours belong together only if a window holds both
        pairs = np.zeros(n + 1, np.int64)
        np.add.at(pairs, frequent + 1, 1)
        np.add.at(pairs, frequent + WINDOW, -1)
        joined = np.cumsum(pairs[:n]) > 0
    else:
        joined = np.ones(n, bool)
    new = good.copy()
    new[1:] &= ~(good[:-1] & joined[1:] & (row[1:] == row[:-1]))
    starts = np.flatnonzero(new)
    stop = good.copy()
    if n:
        stop[:-1] &= ~(good[1:] & ~new[1:])
    ends = np.flatnonzero(stop) + 1
    enough = ends - starts >= least
    return list(zip(row[starts[enough]].tolist(), starts[enough].tolist(), ends[enough].tolist()))


def _dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """The words inside a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) > 0


def _find(column: pa.Array, least: int, exponent: int) -> Iterator[tuple[list[int], list[list[tuple]], list[bytes]]]:
    """Of runs of rows: numbers of words, the runs of each row, and texts without repeated periods."""
    for _, data, offsets in text_chunks(column):
        starts, ends, bounds = word_ranges(data, offsets)
        stretches = candidate_stretches(hash_ranges(data, starts, ends), bounds, least, exponent)
        raw = data.tobytes()
        words = {}
        for row, _, _ in stretches:
            if row not in words:
                words[row] = raw[offsets[row] : offsets[row + 1]].split()
        parts = [words[row][a - bounds[row] : b - bounds[row]] for row, a, b in stretches]
        by_row: dict[int, list[np.ndarray]] = {}
        for (row, a, _), found in zip(stretches, runs_of(parts, least, exponent)):
            if len(found):
                found[:, 0] += a - bounds[row]
                by_row.setdefault(row, []).append(found)
        counts, runs, kept = np.diff(bounds).tolist(), [], []
        for row in range(len(counts)):
            if row in by_row:
                rows = np.concatenate(by_row[row])
                gone = _dropped(counts[row], rows)
                kept.append(b" ".join([w for w, drop in zip(words[row], gone.tolist()) if not drop]))
                runs.append(rows.tolist())
            else:
                kept.append(b" ".join(raw[offsets[row] : offsets[row + 1]].split()))
                runs.append([])
        yield counts, runs, kept


def find_runs(docs: DataFrame, least: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> DataFrame:
    """The periodic runs of words in each whole text.

    Reads ``text``; returns all columns with ``n_words`` (long), ``runs`` (start, length, period; by start and
    then period) and ``collapsed``: the words that no run contains after its first period, joined by one
    space. A null or empty text has no words and an empty collapsed text. Rows are judged each for itself, so
    repeated rows and ties keep their results; an empty table stays empty. Columns with these three names are
    replaced; others pass through. ``exponent`` must be 2 or more, as a shorter repetition is no run.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run holds two words and two periods at least")
    new = ("n_words", "runs", "collapsed")
    df = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in new))
    kinds = T._parse_datatype_string(f"n_words long, runs {RUNS}, collapsed string")
    schema = T.StructType([*df.schema.fields, *kinds.fields])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for counts, runs, kept in _find(batch.column(batch.schema.names.index("text")), least, exponent):
                part = batch.slice(at, len(counts))
                flat = np.array([run for rows in runs for run in rows], np.int64).reshape(-1, 3)
                upto = np.concatenate(([0], np.cumsum([len(rows) for rows in runs]))).astype(np.int32)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run_type.value_type))
                columns = [
                    *part.columns,
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(upto), fields),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *new])
                at += len(counts)

    return df.mapInArrow(find, schema)
