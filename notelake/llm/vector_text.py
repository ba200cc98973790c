"""Words and shingles of whole Arrow text columns in numpy, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << max(8, (n - 1).bit_length())
        factors = np.full(size, _MULTIPLIER, np.uint64)
        factors[0] = 1
        _powers = np.multiply.accumulate(factors)
    return _powers


def text_chunks(column: pa.Array, table: bytes | None = None, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of its texts): consecutive rows of a string column; null is the empty text."""
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        raw = data[int(at[row]) : int(at[end])].to_pybytes() if data is not None else b""
        yield row, np.frombuffer(raw.translate(table) if table else raw, np.uint8), at[row : end + 1] - at[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text with the number of all at the end)."""
    gap = _SPACE[data]
    begins = ~gap
    begins[1:] &= gap[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begins[firsts] = ~gap[firsts]
    starts = np.flatnonzero(begins)
    stops = ~gap
    stops[:-1] &= gap[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    stops[lasts] = ~gap[lasts]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A uint64 for each word; equal words have equal ones."""
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    letters = data[np.repeat(starts, sizes) + place].astype(np.uint64) + np.uint64(1)
    letters *= _power_table(int(sizes.max()))[place]
    return mix(np.add.reduceat(letters, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A uint64 for each run of n words that lies in the array; the caller leaves out those across texts."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    factor = 1
    for i in range(n):
        factor = factor * 0xA0761D6478BD642F % (1 << 64) | 1
        out += words[i : i + len(out)] * np.uint64(factor)
    return mix(out)
