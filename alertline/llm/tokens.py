"""Token ids of whole texts, with each distinct piece of text encoded once in a worker process.

A tokenizer that cuts its input at white space gives the same ids piece by piece as over the whole text,
if the pieces are cut where it must cut as well. The pieces of many texts are found and told apart with
numpy, by 64-bit hashes; ids of known ones are copied. Which files cut their input so is read from their
rules; texts go whole through a tokenizer with other rules. A new piece of plain letters, digits and ASCII
signs is cut into words as the pre-tokenizers of these files do, and words not met before go to the file's
model; any other piece, and any text with white space beyond ASCII, goes through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from alertline.llm.text import hash_ranges, text_chunks, word_ranges

REMEMBERED_PIECES = 1_000_000
REMEMBERED_WORDS = 150_000
LONGEST_REMEMBERED = 256

_LETTERS = "a-zA-ZÀ-ÖØ-öø-įı-ɏ"
_PLAIN = re.compile(rf"[ \n]?[!-~{_LETTERS}]+")
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d|"
_DROPPING = re.compile(rf"{_SHORT}[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_KEEPING = re.compile(rf"{_SHORT} ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\n")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


#: The rules of the files whose pieces are cut here (options that only move offsets left out).
_RULES = {
    True: {
        "normalizer": {
            "type": "Sequence",
            "normalizers": [
                {"type": "NFC"},
                {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
                {"type": "Lowercase"},
            ],
        },
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {
                    "type": "Split",
                    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                    "behavior": "Removed",
                    "invert": True,
                },
                {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
            ],
        },
    },
    False: {
        "normalizer": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    },
}


def _rules_of(part: object) -> object:
    """Rules without options that only move offsets."""
    if isinstance(part, dict):
        return {k: _rules_of(v) for k, v in part.items() if k != "trim_offsets"}
    return [_rules_of(x) for x in part] if isinstance(part, list) else part


def cuts_at_spaces(path: str) -> bool | None:
    """Whether a file's rules drop white space (True) or keep it (False) at its cuts; None for other rules."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    stated = {k: _rules_of(rules.get(k)) for k in ("normalizer", "pre_tokenizer")}
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or not t["special"] for t in rules.get("added_tokens") or []):
        return None
    return next((drops for drops, known in _RULES.items() if stated == known), None)


def _byte_signs() -> dict[int, int]:
    """The sign that byte-level models have for each byte: printable ones stand for themselves."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: 256 + k for k, b in enumerate(rest)}


_SIGNS = _byte_signs()


class _Memory(dict):
    """Results by key. When REMEMBERED_WORDS are held, those not asked for since the last time are forgotten."""

    def __init__(self, find: Callable[[str], list[int]]) -> None:
        self.find = find
        self.older: dict[str, list[int]] = {}

    def __missing__(self, key: str) -> list[int]:
        found = self.older.get(key)
        if found is None:
            found = self.find(key)
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED_WORDS:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Encode texts with a tokenizer file.

    ``drops_spaces`` says that white space never reaches the ids, so that pieces are words; otherwise a
    piece is a word with the white space before it. Strings of special tokens are ordinary text. Null and
    empty texts have no ids. A file with other rules than ``drops_spaces`` states encodes whole texts.
    """

    def __init__(self, path: str, drops_spaces: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.drops_spaces = drops_spaces
        self.by_pieces = cuts_at_spaces(path) is drops_spaces
        self.words = _Memory(self._word)
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.empty(0, np.uint64)  # ascending; of each: where its ids begin in the store, how many
        self.begin = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.store = np.empty(0, np.uint32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        column = pa.array(texts, pa.string())
        return [x for _, ids, bounds in self.encode_column(column) for x in np.split(ids, bounds[1:-1])]

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of rows of a string column: (first row, ids of all rows of the run, their bounds)."""
        for row, data, offsets in text_chunks(column):
            if not self.by_pieces:
                yield row, *self._whole(data, offsets)
                continue
            starts, ends, bounds = word_ranges(data, offsets)
            if not self.drops_spaces:
                starts, ends, bounds = _with_spaces(starts, ends, bounds, offsets)
            begin, count = self._look_up(data, starts, ends)
            upto = np.concatenate(([0], np.cumsum(count)))
            ids = self.store[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])]
            bounds = upto[bounds]
            odd = self._odd_rows(data, offsets)
            if odd:
                parts = np.split(ids, bounds[1:-1])
                for k in odd:
                    text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
                    parts[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                ids = np.concatenate(parts)
                bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            yield row, ids, bounds

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of whole texts, and their bounds."""
        texts = (data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True))
        ids = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
        return np.concatenate(ids), np.concatenate(([0], np.cumsum([len(x) for x in ids])))

    def _odd_rows(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Rows with other white space than ASCII's, where a cut may be wrong."""
        if self.drops_spaces:
            return []
        unsure = np.flatnonzero((data >= 0x1C) & (data <= 0x1F) | (data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
        rows = np.unique(np.searchsorted(offsets, unsure, side="right") - 1).tolist()
        return [k for k in rows if _OTHER_SPACE.search(data[offsets[k] : offsets[k + 1]].tobytes().decode())]

    def _look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece begin in the store, and how many they are."""
        if not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        distinct, first, inverse = np.unique(hash_ranges(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > REMEMBERED_PIECES:
            self._forget()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            pairs = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            ids = [self._piece(raw[a:b].decode()) for a, b in pairs]
            count = np.array([len(x) for x in ids], np.int64)
            flat = np.array([i for x in ids for i in x], np.uint32)
            begin = len(self.store) + np.cumsum(count) - count
            self.store = np.concatenate((self.store, flat))
            self.hashes, self.begin, self.count = (
                np.insert(old, at[new], add)
                for old, add in ((self.hashes, distinct[new]), (self.begin, begin), (self.count, count))
            )
            at = np.searchsorted(self.hashes, distinct)
        return self.begin[at][inverse], self.count[at][inverse]

    def _piece(self, piece: str) -> list[int]:
        if not _PLAIN.fullmatch(piece):
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        words = _DROPPING.findall(piece.lower()) if self.drops_spaces else _KEEPING.findall(piece)
        if len(words) == 1:
            return self.words[words[0]]
        return [i for word in words for i in self.words[word]]

    def _word(self, word: str) -> list[int]:
        if word.isascii():  # a quicker way for most words
            signs = word.replace(" ", chr(_SIGNS[32])).replace("\n", chr(_SIGNS[10]))
        else:
            signs = word.encode().decode("latin-1").translate(_SIGNS)
        return [token.id for token in self.model.tokenize(signs)]


def _with_spaces(
    starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces that begin where the word before ended, and pieces of the white space at the end of rows."""
    filled = np.flatnonzero(bounds[1:] > bounds[:-1])
    begin = np.empty_like(starts)
    begin[1:] = ends[:-1]
    begin[bounds[filled]] = offsets[filled]
    last = offsets[:-1].copy()
    last[filled] = ends[bounds[filled + 1] - 1]
    trailing = np.flatnonzero(last < offsets[1:])
    if not len(trailing):
        return begin, ends, bounds
    at = bounds[trailing + 1]
    begin, ends = np.insert(begin, at, last[trailing]), np.insert(ends, at, offsets[trailing + 1])
    extra = np.zeros(len(bounds), np.int64)
    extra[trailing + 1] = 1
    return begin, ends, bounds + np.cumsum(extra)


@lru_cache(maxsize=2)
def encoder(path: str, drops_spaces: bool) -> Encoder:
    """One encoder per file and worker process."""
    return Encoder(path, drops_spaces)
