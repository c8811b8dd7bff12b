"""Words of Arrow string columns as flat columns, and CRC-32 sums of many short byte strings at once.

Texts are taken in pieces of bounded size: short ones together, a long one cut at places where no word runs, so the memory
of a task depends on the piece and on the longest single text, not on the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20
#: What separates words of letters and digits, once A-Z are lower case; every longer character belongs to words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_BYTES = np.arange(256)
_SEPARATES = (_BYTES < 0x30) | ((_BYTES >= 0x3A) & (_BYTES <= 0x40)) | ((_BYTES >= 0x5B) & (_BYTES <= 0x60)) | (
    (_BYTES >= 0x7B) & (_BYTES <= 0x7F))
_VECTOR_BYTES = 64


def _crc_table() -> np.ndarray:
    """The table of the reflected polynomial 0xEDB88320: eight shifts of each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | int = 0) -> np.ndarray:
    """CRC-32 of each ``data[starts[i]:ends[i]]``, carried on from ``before``; all strings advance a byte at a time together,
    the few long ones go to zlib."""
    sums = np.array(np.broadcast_to(np.asarray(before, np.uint32), len(starts)))
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    n_long = int(np.searchsorted(-sizes[order], -_VECTOR_BYTES, "left"))
    for i in order[:n_long]:
        sums[i] = zlib.crc32(data[starts[i]:ends[i]], int(sums[i]))
    order = order[n_long:]
    if not len(order):
        return sums
    state, at, left = ~sums[order], starts[order], sizes[order]
    active = np.searchsorted(-left, -np.arange(int(left[0])), "left")
    for t, k in enumerate(active):
        state[:k] = _CRC[(state[:k] ^ data[at[:k] + t]) & np.uint32(255)] ^ (state[:k] >> np.uint32(8))
    sums[order] = ~state
    return sums


def crc32_of(strings: pa.Array, before: np.ndarray | int = 0) -> np.ndarray:
    data, offsets = string_bytes(strings)
    return crc32(data, offsets[:-1], offsets[1:], before)


def split_words(texts: pa.Array, between: str = BETWEEN_WORDS) -> tuple[pa.Array, np.ndarray]:
    """(words, offsets): ``words[offsets[i]:offsets[i+1]]`` are the words of text i, A-Z in lower case."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), between)
    flat, offsets = pc.list_flatten(lists), lists.offsets.to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)
    counted = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return flat.filter(some), counted[offsets - offsets[0]]


def encoded(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct values, number of each row's value)."""
    held = column.dictionary_encode()
    return held.dictionary, held.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _cut(text: pa.Scalar, most: int) -> Iterator[pa.Array]:
    data = np.frombuffer(text.as_buffer(), np.uint8)
    at = 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data):
            found = np.flatnonzero(_SEPARATES[data[end:end + (1 << 16)]])
            if len(found):
                end += int(found[0])
                break
            end = min(end + (1 << 16), len(data))
        yield pa.array([data[at:end].tobytes().decode()], pa.string())
        at = end


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, pa.Array, bool]]:
    """(first row, texts, does it carry on?) of a string column: rows of about ``most`` bytes together, or one part of a
    longer text, which ends where no word runs; the parts of a text follow each other."""
    sizes = np.diff(string_bytes(texts)[1])
    at = 0
    while at < len(sizes):
        if sizes[at] > most:
            for n, part in enumerate(_cut(texts[at], most)):
                yield at, part, n > 0
            at += 1
            continue
        total, end = 0, at
        while end < len(sizes) and total + sizes[end] <= most:
            total += int(sizes[end])
            end += 1
        yield at, texts.slice(at, end - at), False
        at = end
