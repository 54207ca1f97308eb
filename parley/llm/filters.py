"""Bloom filters built by Spark in segments of a fixed size.

All bits of a key lie in one segment, so that every segment can be built by its own task
from its own keys. A filter has at most ``max_bytes``; that is what bounds a broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT_BITS = 1 << 19
PROBES = 6


def segments_for(keys: int, bits_per_key: int, max_bytes: int) -> int:
    """How many segments a filter of so many keys gets: a power of two, at least one, within ``max_bytes``."""
    most = max(1, max_bytes * 8 // SEGMENT_BITS)
    want = max(1, -(-keys * bits_per_key // SEGMENT_BITS))
    return min(1 << (most.bit_length() - 1), 1 << (want - 1).bit_length())


def segment_of(key: Column, segments: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 40), F.lit(segments))


def positions(keys: np.ndarray, segments: int, probes: int = PROBES) -> np.ndarray:
    """Bit positions (keys x probes) of well mixed 64-bit keys in the whole filter."""
    base = ((keys >> np.uint64(40)) & np.uint64(segments - 1)) * np.uint64(SEGMENT_BITS)
    step = (keys >> np.uint64(20)) | np.uint64(1)
    inside = np.uint64(SEGMENT_BITS - 1)
    return np.stack([base + ((keys + np.uint64(i) * step) & inside) for i in range(probes)], axis=1)


def build(keys: DataFrame, segments: int) -> np.ndarray:
    """The filter's bytes. ``keys``: one column ``key`` of well mixed longs.

    Each task sends one finished segment, so the driver receives the filter once.
    """

    def segment(frame: pd.DataFrame) -> pd.DataFrame:
        h = frame["key"].to_numpy().view(np.uint64)
        number = int((h[0] >> np.uint64(40)) & np.uint64(segments - 1))
        bits = np.zeros(SEGMENT_BITS, dtype=bool)
        for at in range(0, len(h), 100_000):
            bits[(positions(h[at : at + 100_000], segments) - np.uint64(number * SEGMENT_BITS)).ravel().astype(np.int64)] = True
        return pd.DataFrame({"segment": [number], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    got = keys.groupBy(segment_of(F.col("key"), segments).alias("s")).applyInPandas(lambda _, frame: segment(frame), "segment long, bits binary").collect()
    out = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for row in got:
        out[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def contains(bits: np.ndarray, segments: int, keys: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """Whether each key is (or, rarely, seems to be) in the filter."""
    found = np.ones(len(keys), dtype=bool)
    for at in range(0, len(keys), 200_000):
        where = positions(keys[at : at + 200_000], segments, probes)
        found[at : at + 200_000] = ((bits[where >> np.uint64(3)] >> (where & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
    return found
