"""Words of texts: as column expressions, and as hashed numpy arrays inside tasks.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage
return. Both forms cut the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]"
SHINGLE_WORDS = 5
CHUNK_BYTES = 4 << 20

_U = np.uint64
_MIX = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")


def lower_ascii(text: Column) -> Column:
    """A text with A-Z in lower case and all else as it is."""
    if_ascii = F.lower(text)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, if_ascii).otherwise(F.translate(text, upper, lower))


def n_words(text: Column) -> Column:
    """How many words a text has, as a long."""
    return F.size(words(text)).cast("long")


def keep_where(df: DataFrame, flag: str) -> DataFrame:
    """The rows whose boolean column ``flag`` is true.

    A plain filter on a worked-out column is moved below the steps that make it, with all of them copied
    into one expression that repeats costly parts for each element. Nothing moves below this one.
    """
    mark = F.explode_outer(F.array(F.when(F.col(flag), F.lit(1))))
    return df.withColumn("_keep", mark).filter("_keep IS NOT NULL").drop("_keep")


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; wraps around."""
    x = (x ^ (x >> _U(32))) * _MIX[1]
    x = (x ^ (x >> _U(29))) * _MIX[0]
    return x ^ (x >> _U(32))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes: (first row, bytes, row offsets).

    A single longer text is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_KEEP = np.array([0, *((1 << (8 * n)) - 1 for n in range(1, 8)), (1 << 64) - 1], dtype=_U)


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a run of texts begin and end, and the word offsets of the rows."""
    n = len(data)
    word = np.zeros(n + 1, bool)
    np.take(_IS_WORD, data, out=word[:n])
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = word[: n - 1]
    starts = np.flatnonzero(word[:n] & (~before | first[:n]))
    ends = np.flatnonzero(word[:n] & (~word[1:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts
    hashes = mix(length.astype(_U) * _MIX[0] ^ (eight[starts] & _KEEP[np.minimum(length, 8)]))
    at, more = 8, np.flatnonzero(length > 8)
    while len(more):
        left = length[more] - at
        hashes[more] = mix(hashes[more] ^ (eight[starts[more] + at] & _KEEP[np.minimum(left, 8)]))
        at += 8
        more = more[left > 8]
    return hashes


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a run of texts (A-Z lower-cased), and the word offsets of the rows."""
    starts, ends, bounds = word_ranges(data, offsets)
    return hash_ranges(_LOWER[data], starts, ends), bounds


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row.

    Fewer words than ``width`` make one shingle of the whole sequence; no words make an empty set.
    """
    n = len(hashes)
    rolling = np.zeros(max(0, n - width + 1), _U)
    for j in range(width):
        rolling = mix(rolling + hashes[j : j + len(rolling)])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolling[a : b - width + 1]))
        elif b > a:
            one = np.array([b - a], _U)
            for x in hashes[a:b]:
                one = mix(one ^ x)
            out.append(one)
        else:
            out.append(np.empty(0, _U))
    return out
