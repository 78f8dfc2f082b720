"""Words of many texts at once: boundaries, hashes and shingles with numpy over UTF-8 bytes.

All separators of the word rules used here are ASCII, and every byte of a longer UTF-8 sequence is
0x80 or more, so words can be cut on bytes.  Texts are worked through in blocks of about a megabyte;
a block holds whole texts, so peak memory is about 60 bytes per byte of the longest text.

A word is hashed as the sum of a random number per byte times a power of an odd base, modulo 2**64,
and then mixed.  Sequences of words are sums of word hashes times fixed random odd numbers.  Where a
result hangs on equality alone, callers use two independent hashes (128 bits) or compare the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_random = np.random.default_rng(20240611)
_BYTE = [_random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASE = [0x9E3779B97F4A7C13 | 3, 0xC2B2AE3D27D4EB4B | 3]
_INVERSE = [pow(b, -1, 1 << 64) for b in _BASE]
#: Multipliers of the words of a sequence, by place; sequences of up to 64 words.
_PLACE = _random.integers(1, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(seed: int, inverse: bool, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base (or of its inverse) modulo 2**64."""
    have = _powers.get((seed, inverse))
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        out = np.empty(size, np.uint64)
        base = (_INVERSE if inverse else _BASE)[seed]
        out[0], done = 1, 1
        while done < size:
            more = min(done, size - done)
            out[done:done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        if size > BLOCK_BYTES + 1:
            return out
        have = _powers[seed, inverse] = out
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def byte_map(separators: bytes, lower: bool) -> np.ndarray:
    """What each byte becomes: 0 for a separator, a-z for A-Z if ``lower``, itself otherwise.

    A zero byte that is no separator becomes 0xFF, which UTF-8 does not use.
    """
    table = np.arange(256, dtype=np.uint8)
    table[0] = 0xFF
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words between space and the ASCII controls 9 to 13.
SPACES = bytes([0x20, 9, 10, 11, 12, 13])
#: Words of letters, digits and everything beyond ASCII.
NOT_ALNUM = bytes(c for c in range(128) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123))


@dataclass
class Words:
    """The words of some texts; word i is ``data[start[i]:end[i]]`` and belongs to text ``doc[i]``."""

    raw: np.ndarray
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        value = _BYTE[seed][self.data]
        value *= _power(seed, False, n)[:n]
        np.cumsum(value, out=total[1:])
        h = total[self.end]
        h -= total[self.start]
        h *= _power(seed, True, n + 1)[self.start]
        return mix(h)

    def word_bytes(self, i: int, j: int) -> bytes:
        """Words i to j (exclusive), joined by single zero bytes."""
        return b"\0".join(self.data[self.start[k]:self.end[k]].tobytes() for k in range(i, j))


def sequence_hashes(h: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of ``length`` hashes, at the place of its first; also runs across texts."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _PLACE[seed, 0]
    for i in range(1, length):
        out += h[i:i + n] * _PLACE[seed, i]
    return mix(out)


def inside(words: Words, length: int) -> np.ndarray:
    """Whether the run of ``length`` words from each word on lies in one text (for all but the last)."""
    n = len(words.doc) - length + 1
    return words.doc[:max(n, 0)] == words.doc[length - 1:] if n > 0 else np.zeros(0, bool)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets of texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``block_bytes``: first, last (exclusive), their bytes, their offsets."""
    data, offsets = buffers(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block_bytes, "right")) - 1)
        yield i, min(j, n), data[offsets[i]:offsets[min(j, n)]], offsets[i:min(j, n) + 1] - offsets[i]
        i = min(j, n)


def split(raw: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> Words:
    """Words of a block: runs of bytes that ``table`` does not map to 0, cut where a text ends."""
    data = table[raw]
    n = len(data)
    full = np.empty(n + 1, bool)
    full[:n] = data != 0
    full[n] = False
    starts = full.copy()
    starts[1:] &= ~full[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts[heads] = full[heads]
    ends = np.zeros(n + 1, bool)
    ends[1:] = full[:-1] & ~full[1:]
    tails = heads[heads > 0]
    ends[tails] |= full[tails - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(raw, data, bounds, start, end, doc, first)


def word_blocks(texts: pa.Array, table: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """Words of each run of texts of a batch."""
    for i, j, raw, bounds in blocks(texts):
        yield i, j, split(raw, bounds, table)
