"""Vectorised word and word-window hashing for batches of texts.

A word is a maximal run of characters other than U+0020 and U+0009 to U+000D.
These separators are single bytes in UTF-8 and no byte of a longer character
equals them, so words are found on the bytes. Hashes have 64 bits: a random
table maps bytes to numbers, powers of an odd base weigh positions (sums wrap,
and the base has an inverse), and a finaliser mixes the result.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WEIGHTS = np.random.default_rng(20240229).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _byte_table(lower: bool) -> np.ndarray:
    table = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        table[65:91] = table[97:123]
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """Words of some whole texts: `text` is an index into the batch, `start` and `end` are byte offsets in that text."""

    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


class WordHasher:
    """Hashes the words of texts, in slices of bounded size that are cut at white space."""

    def __init__(self, lower: bool, slice_bytes: int = 1 << 18) -> None:
        self.table, self.slice_bytes = _byte_table(lower), slice_bytes
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, min(2 * len(self.powers), self.slice_bytes + 4096))
            with np.errstate(over="ignore"):
                self.powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, _BASE, np.uint64))))
                self.inverses = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, _INVERSE, np.uint64))))

    def _slice(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, starts and ends of the words of some bytes."""
        inside = np.concatenate(([False], ~SPACE[raw], [False]))
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = turns[0::2], turns[1::2]
        self._grow(len(raw) + 1)
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.table[raw] * self.powers[: len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverses[starts]), starts, ends

    def words(self, texts: list[bytes]) -> Words:
        """All words of `texts`, in order."""
        parts: list[tuple[np.ndarray, ...]] = []
        at, sizes = 0, 0
        group: list[bytes] = []
        for k, text in enumerate(texts):
            if len(text) > self.slice_bytes:
                parts += [self._many(group, at), self._long(text, k)]
                group, sizes, at = [], 0, k + 1
                continue
            group.append(text)
            sizes += len(text) + 1
            if sizes >= self.slice_bytes:
                parts.append(self._many(group, at))
                group, sizes, at = [], 0, k + 1
        parts.append(self._many(group, at))
        return Words(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def _many(self, group: list[bytes], at: int) -> tuple[np.ndarray, ...]:
        raw = np.frombuffer(b"\n".join(group), np.uint8)
        found, starts, ends = self._slice(raw)
        begins = np.concatenate(([0], np.cumsum([len(x) + 1 for x in group], dtype=np.int64)))[:-1] if group else np.zeros(1, np.int64)
        text = np.searchsorted(begins, starts, "right") - 1
        return found, text + at, starts - begins[text], ends - begins[text]

    def _long(self, text: bytes, k: int) -> tuple[np.ndarray, ...]:
        raw, at, out = np.frombuffer(text, np.uint8), 0, []
        while at < len(raw):
            to = min(len(raw), at + self.slice_bytes)
            while to < len(raw):  # on to the next white space
                gaps = np.flatnonzero(SPACE[raw[to : to + 4096]])
                to = min(len(raw), to + (int(gaps[0]) if len(gaps) else 4096))
                if len(gaps):
                    break
            found, starts, ends = self._slice(raw[at:to])
            out.append((found, starts + at, ends + at))
            at = to
        found, starts, ends = (np.concatenate(x) for x in zip(*out, strict=True))
        return found, np.full(len(found), k, np.int64), starts, ends


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each position on; the last size - 1 positions have none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * _WEIGHTS[0]
    for k in range(1, size):
        total += hashes[k : k + n] * _WEIGHTS[k]
    return mix(total)


def shingles(words: Words, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct `size`-word windows of each text, sorted by text and hash.

    A text with fewer words, but at least one, has its whole sequence as the only window.
    """
    counts = np.bincount(words.text, minlength=n_texts)
    found = windows(words.hash, size)
    whole = words.text[: len(found)] == words.text[size - 1 :] if len(found) else np.zeros(0, bool)
    text, value = words.text[: len(found)][whole], found[whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        begins = np.concatenate(([0], np.cumsum(counts)))[:-1][short]
        total = counts[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(size - 1):
            has = counts[short] > k
            total[has] += words.hash[begins[has] + k] * _WEIGHTS[k]
        text, value = np.concatenate((text, short)), np.concatenate((value, mix(total)))
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def text_groups(texts: pa.Array, most_bytes: int, most_rows: int = 20_000) -> Iterator[tuple[int, list[bytes]]]:
    """The same for an Arrow array of strings, read from its buffers: no text becomes a Python string."""
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = memoryview(data) if data is not None else memoryview(b"")
    gone = np.asarray(texts.is_null()) if texts.null_count else None
    first = 0
    while first < len(texts):
        last = min(int(np.searchsorted(at, at[first] + most_bytes, "right")) - 1, first + most_rows, len(texts))
        last = max(last, first + 1)
        yield first, [b"" if gone is not None and gone[k] else bytes(raw[at[k] : at[k + 1]]) for k in range(first, last)]
        first = last


def give_back() -> None:
    """Returns freed memory to the system: workers are reused, and what a stage held would add to the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def byte_batches(texts: list, most_bytes: int, most_rows: int = 20_000) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, UTF-8 texts) of consecutive rows with at most so many bytes, or one row; null is empty."""
    at, size, group = 0, 0, []
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text) if text is not None else b""
        if group and (size + len(raw) > most_bytes or len(group) >= most_rows):
            yield at, group
            at, size, group = k, 0, []
        group.append(raw)
        size += len(raw)
    if group:
        yield at, group
