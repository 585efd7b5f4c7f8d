"""Words of a batch of texts as numpy arrays: one pass over the UTF-8 bytes, no object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer text is worked on alone.
BLOCK_BYTES = 2 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A fixed random 64-bit value for each byte, and the odd base of the rolling hash with its inverse.
BYTE_VALUE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of murmur3: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64; kept for the next block."""
    out = _POWERS.get(int(base))
    if out is None or len(out) < n:
        out = np.ones(max(n, BLOCK_BYTES + 1), dtype=np.uint64)
        done = 1
        while done < len(out):
            step = min(done, len(out) - done)
            out[done : done + step] = out[:step] * (out[done - 1 : done] * base)
            done += step
        if len(out) <= 4 * BLOCK_BYTES:
            _POWERS[int(base)] = out
    return out[:n]


@dataclass
class Words:
    """``doc``: index of each word's text in the block; ``start``/``end``: its bytes in ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def _sums(self) -> np.ndarray:
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[self.data] * powers(BASE, len(self.data)), out=sums[1:])
        return sums

    def hashes(self, prefix: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every block and process.

        With ``prefix``, of its first bytes only; 0 for words that aren't longer than that.
        """
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        length = (self.end - self.start).astype(np.uint64)
        end = np.minimum(self.end, self.start + prefix) if prefix else self.end
        inner = (self._sums[end] - self._sums[self.start]) * powers(INVERSE, len(self.data) + 1)[self.start]
        if prefix:
            return np.where(length > prefix, mix(inner + np.uint64(prefix << 32)), np.uint64(0))
        return mix(inner + length)


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes: (first row, end row, bytes,
    offsets from 0). Null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, len(texts))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False, gap: np.ndarray = _SPACE) -> Words:
    """Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed
    and carriage return; those are never part of another UTF-8 character. ``lower``: A-Z only.
    ``gap``: other bytes that part words."""
    if lower:
        data = _LOWER[data]
    inside = ~gap[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return Words(data, offsets, doc, start, end)


def runs(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Offsets of each document's words in the word arrays."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 64-bit hash) of each word. A text longer than a block is cut between words, so that
    its arrays are those of its words, not several numbers for each byte."""
    if len(offsets) > 2 or len(data) <= 2 * BLOCK_BYTES:
        words = words_of(data, offsets, lower)
        return words.doc, words.hashes()
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data) and not _SPACE[data[at:end]].any():  # one word longer than a block
            end = min(len(data), end + BLOCK_BYTES)
        if end < len(data):
            end = at + int(np.flatnonzero(_SPACE[data[at:end]])[-1]) + 1
        parts.append(words_of(data[at:end], np.array([0, end - at]), lower).hashes())
        at = end
    hashes = np.concatenate(parts)
    return np.zeros(len(hashes), dtype=np.int64), hashes
