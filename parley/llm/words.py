"""Words and word-window hashes of Arrow text columns, vectorised over whole batches.

A word is a run of bytes other than ``\\x20`` and ``\\x09-\\x0D``. All functions work on
the UTF-8 bytes of a batch at once; the only loops are over slices of a batch, which
bound the size of the intermediate arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD1342543DE82EF95)
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, row offsets) for runs of rows of about ``limit`` bytes.

    A null text has no bytes. A single row longer than ``limit`` is yielded whole.
    """
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(texts))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


@dataclass
class Words:
    """Words of one slice: byte starts and ends, row of each word, and first word of each row."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    bounds: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(offsets) - 1
    if len(data) == 0:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, empty, np.zeros(n + 1, np.int64))
    inside = ~_WHITE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offsets)
    return Words(starts, np.flatnonzero(ends) + 1, np.repeat(np.arange(n), np.diff(bounds)), bounds)


def hash_words(data: np.ndarray, words: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``lower`` treats A-Z as a-z."""
    if len(words.starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = words.ends - words.starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), _P)]))
    value = (_BYTE_LOWER if lower else _BYTE)[data[np.repeat(words.starts, lengths) + within]]
    value *= powers[within]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``size`` consecutive entries, by doubling."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, block, width, power = None, 0, hashes, 1, np.full(1, _Q)
    rest = size
    while rest:
        if rest & 1:
            part = block[done : done + n]
            out = part.copy() if out is None else out * power + part
            done += width
        rest >>= 1
        if rest:
            block = block[:-width] * power + block[width:]
            power = power * power
            width *= 2
    return mix(out)


def sliding_min(keys: np.ndarray, size: int) -> np.ndarray:
    """The smallest of every ``size`` consecutive keys."""
    n = len(keys) - size + 1
    if n <= 0:
        return keys[:0]
    block, width = keys, 1
    while width * 2 <= size:
        block = np.minimum(block[:-width], block[width:])
        width *= 2
    return np.minimum(block[:n], block[size - width : size - width + n])
