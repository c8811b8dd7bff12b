"""Words of a batch of texts as arrays: bounds and 64-bit hashes, without a Python object per word.

The hash of a span is a polynomial in its bytes modulo 2**64, taken from prefix sums, then mixed.  It depends on the bytes
alone, so every executor gets the same value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

_BYTES = np.arange(256)
SPACE = np.isin(_BYTES, [0x20, *range(0x09, 0x0E)])
#: Words of letters and digits: all other ASCII separates them, bytes of longer characters belong to them.
NO_LETTER = (_BYTES < 128) & ~np.isin(_BYTES, list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
MARK = (_BYTES > 32) & (_BYTES < 127) & ~LETTER & ~((_BYTES >= 48) & (_BYTES <= 57))
FOLD = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        held = _POWERS[base] = np.cumprod(factors, dtype=np.uint64)
    return held


@dataclass
class Words:
    """Words of several texts, one after the other.  ``docs[i]:docs[i+1]`` are the words of text i; starts and ends are
    bytes within its own text."""

    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    data: np.ndarray
    texts: np.ndarray
    sums: np.ndarray

    def hashes(self, longest: int | None = None, last: bool = False) -> np.ndarray:
        """Of the words, or of their first (or last) ``longest`` bytes."""
        lo, hi = self.starts, self.ends
        if longest is not None:
            lo, hi = (np.maximum(lo, hi - longest), hi) if last else (lo, np.minimum(hi, lo + longest))
        inverse = _powers(_INVERSE, len(self.sums))
        return mix((self.sums[hi] - self.sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))

    def lengths(self) -> np.ndarray:
        return self.ends - self.starts

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs) - 1), np.diff(self.docs))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without NULLs."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(texts: pa.Array, separators: np.ndarray = SPACE) -> Words:
    """Words of a string column, ASCII letters folded to lower case."""
    data, offsets = text_bytes(texts)
    data = FOLD[data]
    inside = ~separators[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < n]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    after[lasts] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n + 1)[:n], out=sums[1:])
    return Words(starts, ends, np.searchsorted(starts, offsets), data, offsets, sums)


def slices(texts: pa.Array, most_bytes: int = 8 << 20):
    """(first, last) row ranges of a column that hold about so many bytes, or one row if that is longer."""
    sizes = np.diff(text_bytes(texts)[1])
    at = 0
    while at < len(sizes):
        total, end = 0, at
        while end < len(sizes) and (end == at or total + sizes[end] <= most_bytes):
            total += int(sizes[end])
            end += 1
        yield at, end
        at = end
