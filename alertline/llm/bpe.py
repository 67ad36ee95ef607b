"""Byte-level BPE from a tokenizer file: texts to token ids and back.

A text is cut into words by the pre-tokenizer's pattern, and words met for the first time are merged. A word
holds its parts in a contiguous array, and beside it the rank at every boundary of two parts. The smallest rank
(the first of equal ones) is found by a scan; its boundary is deleted, and the ranks of the boundaries next to
it are refreshed. New words of one length are rows of a matrix and go through these steps together. Words of
more than ``SHORT_WORD`` bytes, for which scans would take quadratic time, keep the same ranks in a heap; the
ids are the same.

Strings of the file's added tokens become their ids wherever they stand, as in the tokenizers library.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertline.llm.tokens import _byte_signs

SHORT_WORD = 256
FEW_WORDS = 8
REMEMBERED_WORDS = 200_000
RUN_CHARS = 2 << 20
NO_RANK = 1 << 40

#: Fixed value: how byte-level tokenizer files of this kind cut texts into words.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same for texts of plain signs and Latin letters only, which the quicker engine can cut.
_LATIN = "a-zA-ZÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[\n -~{_LATIN}]*")
_PLAIN_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^ \n{_LATIN}0-9]+|[ \n]+(?![^ \n])|[ \n]+")


class RankBpe:
    """The words, merges and added tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model, cut = rules["model"], rules.get("pre_tokenizer") or {}
        plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
        plain = plain and not any(model.get(k) for k in ("byte_fallback", "ignore_merges", "fuse_unk"))
        by_bytes = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        added = rules.get("added_tokens") or []
        as_it_is = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        if model["type"] != "BPE" or rules.get("normalizer") or not (plain and by_bytes and as_it_is):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        sign_of = {b: chr(_byte_signs().get(b, b)) for b in range(256)}
        byte_of = {sign: b for b, sign in sign_of.items()}
        vocabulary = model["vocab"]
        self.first = [vocabulary[sign_of[b]] for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(vocabulary[left] << 32 | vocabulary[right], rank)
            self.merged.append(vocabulary[left + right])
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.fromiter(self.pairs.values(), np.int64, len(keys))[order], NO_RANK)
        self.first_ids, self.merged_ids = np.array(self.first), np.array(self.merged)
        self.added = {t["content"]: t["id"] for t in added}
        tokens = {i: token for token, i in vocabulary.items()} | {i: token for token, i in self.added.items()}
        self.bytes_of = {
            i: bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
            for i, token in tokens.items()
        }
        self.cut = regex.compile(PATTERN)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as unsigned 32-bit integers in a row; a null or empty text has none."""
        cut = [self._words(text or "") for text in texts]
        self._learn(set().union(*(words for parts in cut for words in parts[::2])))
        of, added = self.known.__getitem__, self.added
        out = []
        for parts in cut:
            ids = (array("I", [added[p]]).tobytes() if k % 2 else b"".join(map(of, p)) for k, p in enumerate(parts))
            out.append(b"".join(ids))
        return out

    def _words(self, text: str) -> list:
        """The words of a text between strings of added tokens, and these strings, in turn."""
        parts = self.special.split(text) if self.special else [text]
        for k in range(0, len(parts), 2):
            plain = _PLAIN.fullmatch(parts[k])
            parts[k] = (_PLAIN_CUT if plain else self.cut).findall(parts[k])
        return parts

    def _learn(self, words: set[str]) -> None:
        """Know at least these words. Those not asked for since the last time are forgotten when many are held."""
        if len(self.known) > REMEMBERED_WORDS:
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, {}
        for word in words.difference(known):
            found = older.get(word)
            if found is None:
                new.setdefault(len(data := word.encode()), []).append((word, data))
            else:
                known[word] = found
        for length, some in new.items():
            if length > SHORT_WORD or len(some) < FEW_WORDS:
                merge = self._long if length > SHORT_WORD else self._short
                known.update((word, merge(data).tobytes()) for word, data in some)
            else:
                known.update(zip((word for word, _ in some), self._together([data for _, data in some]), strict=True))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def _together(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of one length: each turn deletes one boundary of every word that has one to delete."""
        out: list[bytes] = [b""] * len(words)
        ids = self.first_ids[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        which = np.arange(len(words))
        while len(which):
            width = ids.shape[1]
            at = ranks.argmin(1) if width > 1 else np.zeros(len(which), np.int64)
            rows = np.arange(len(which))
            lowest = ranks[rows, at] if width > 1 else np.full(len(which), NO_RANK)
            done = lowest == NO_RANK
            if done.any():
                raw, step = ids[done].astype("<u4").tobytes(), 4 * width
                for k, word in enumerate(which[done].tolist()):
                    out[word] = raw[k * step : (k + 1) * step]
                more = ~done
                which, ids, ranks, at, lowest = which[more], ids[more], ranks[more], at[more], lowest[more]
                rows = rows[: len(which)]
                if not len(which):
                    break
            ids[rows, at] = self.merged_ids[lowest]
            places = np.arange(width - 1)
            ids = np.take_along_axis(ids, places + (places > at[:, None]), 1)
            ranks = np.take_along_axis(ranks, places[:-1] + (places[:-1] >= at[:, None]), 1)
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self._ranks(ids[has, at[has] - 1], ids[has, at[has]])
            has = np.flatnonzero(at < width - 2)
            ranks[has, at[has]] = self._ranks(ids[has, at[has]], ids[has, at[has] + 1])
        return out

    def decode(self, ids: array) -> str:
        """The text of some ids. Bytes that are no UTF-8 become U+FFFD, ids that the file does not know nothing."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids]).decode("utf-8", "replace")

    def _short(self, data: bytes) -> array:
        """The ids of one word; ``ranks[k]`` is that of the parts on both sides of boundary k."""
        first, pairs, merged = self.first, self.pairs, self.merged
        ids = [first[b] for b in data]
        ranks = [pairs.get(a << 32 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks:
            lowest = min(ranks)
            if lowest == NO_RANK:
                break
            k = ranks.index(lowest)
            del ranks[k], ids[k + 1]
            ids[k] = merged[lowest]
            if k:
                ranks[k - 1] = pairs.get(ids[k - 1] << 32 | ids[k], NO_RANK)
            if k < len(ranks):
                ranks[k] = pairs.get(ids[k] << 32 | ids[k + 1], NO_RANK)
        return array("I", ids)

    def _long(self, data: bytes) -> array:
        """The same merges with linked parts and a heap of (rank, place)."""
        pairs, merged = self.pairs, self.merged
        ids = [self.first[b] for b in data]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = [pairs.get(a << 32 | b, NO_RANK) for a, b in zip(ids, ids[1:])] + [NO_RANK]
        heap = [(rank, k) for k, rank in enumerate(ranks) if rank != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            if ranks[k] != rank:
                continue
            gone = after[k]
            ids[k], ids[gone], ranks[gone] = merged[rank], -1, NO_RANK
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0:
                    right = after[left]
                    ranks[left] = pairs.get(ids[left] << 32 | ids[right], NO_RANK) if right < n else NO_RANK
                    if ranks[left] != NO_RANK:
                        heapq.heappush(heap, (ranks[left], left))
        return array("I", [i for i in ids if i >= 0])


@lru_cache(maxsize=2)
def rank_bpe(path: str) -> RankBpe:
    """One set of rules per file and worker process."""
    return RankBpe(path)


def _runs(column: pa.Array, size: Callable) -> Iterator[tuple[int, list]]:
    """Runs of rows with a bounded sum of sizes (or one row): the first of them, and their values."""
    values, total, start = [], 0, 0
    for row, value in enumerate(column):
        value = value.as_py()
        values.append(value)
        total += size(value)
        if total > RUN_CHARS:
            yield start, values
            values, total, start = [], 0, row + 1
    if values:
        yield start, values


def _with_column(df: DataFrame, name: str, kind: T.DataType, source: str, make: Callable, arrow: pa.DataType) -> DataFrame:
    """``df`` with a column worked out in Python from another one; a column of that name is replaced."""
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()))
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, values in _runs(batch.column(batch.schema.names.index(source)), lambda v: len(v or "")):
                part = batch.slice(first, len(values))
                column = pa.array(make(values), arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, name])

    return df.mapInArrow(add, schema)


def encode_texts(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of whole texts as unsigned little-endian 32-bit integers in a binary column.

    A null or empty text has no ids (empty, not null). Repeated rows stay, an empty table stays empty, other
    columns pass through, and a column named ``ids`` is replaced.
    """
    return _with_column(df, ids, T.BinaryType(), text, lambda texts: rank_bpe(path).encode(texts), pa.binary())


def decode_ids(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of a binary column of ids; null or empty ids make an empty text."""

    def make(values: list[bytes | None]) -> list[str]:
        decode = rank_bpe(path).decode
        return [decode(array("I", value or b"")) for value in values]

    return _with_column(df, text, T.StringType(), ids, make, pa.string())
