"""Words, word hashes and shingle sets of Arrow string columns, computed on the UTF-8 bytes.

A word is a run of bytes outside 0x20 and 0x09-0x0D. In UTF-8 these bytes never occur inside another
character, so runs of bytes and runs of characters agree. Words are hashed to 64 bits with A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_VALUE = np.where(SPACES, 0, _LOWER + 1).astype(np.uint64)
_VALUE_CASED = np.where(SPACES, 0, np.arange(256) + 1).astype(np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.array([0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_powers = np.ones(1, dtype=np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string array; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (n + 1 values)."""
    inside = ~SPACES[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    begin = edges[edges < len(data)]
    first[begin] = inside[begin]
    end = edges[edges > 0] - 1
    last[end] = inside[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, 4096) - 1, _BASE, np.uint64))), dtype=np.uint64)
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, block: int = 1 << 16) -> np.ndarray:
    """64-bit hashes of the words, in blocks so that scratch memory doesn't follow the batch."""
    out = np.empty(len(starts), np.uint64)
    value = _VALUE if lower else _VALUE_CASED
    for a in range(0, len(starts), block):
        b = min(a + block, len(starts))
        base, stop = starts[a], ends[b - 1]
        rel = starts[a:b] - base
        gaps = np.diff(rel, append=stop - base)
        at = np.arange(stop - base) - np.repeat(rel, gaps)
        longest = int((ends[a:b] - starts[a:b]).max())
        np.minimum(at, longest - 1, out=at)  # beyond a word there are only spaces, whose value is 0
        out[a:b] = np.add.reduceat(value[data[base:stop]] * _power(longest)[at], rel)
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x94D049BB133111EB))


def slices(column: pa.Array, most: int = 1 << 20):
    """(first row, number of rows) of consecutive parts of a string array, of about most bytes each."""
    offsets = utf8(column)[1]
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b - a
        a = b


def shingle_sets(column: pa.Array, width: int = 5):
    """For each document the sorted distinct hashes of its word shingles.

    With fewer words than width the whole sequence is one shingle; without words the set is empty.
    """
    for part in slices(column):
        yield from _shingle_sets(column.slice(*part), width)


def _shingle_sets(column: pa.Array, width: int):
    data, offsets = utf8(column)
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    slots = _SLOT[:width] if width <= len(_SLOT) else mix(np.arange(1, width + 1, dtype=np.uint64))
    n = max(0, len(words) - width + 1)
    windows = np.zeros(n, np.uint64)
    for k in range(width):
        windows += words[k : k + n] * slots[k]
    windows = mix(windows)
    for d in range(len(offsets) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= width:
            h = np.sort(windows[a : b - width + 1])
            yield h[np.concatenate(([True], h[1:] != h[:-1]))]
        elif b > a:
            yield mix(np.atleast_1d((words[a:b] * slots[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)))
        else:
            yield words[:0]
