"""Bloom filters in numpy, built by partitions and merged slice by slice."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits set for an item.
PROBES = 3
#: Smallest and largest filter, in bits. The largest is 32 MB, whatever the data.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
SLICE_BYTES = 1 << 17


def bits_for(items: int) -> int:
    """About 8 bits an item, a power of two, between the two bounds. Beyond the upper
    bound more items pass the filter falsely; they cost work and never the result."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, 8 * items - 1).bit_length()))


def positions(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bit of each probe, from the two halves of 64-bit hashes."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (low + np.uint64(i) * high) & np.uint64(bits - 1)


def add(filt: np.ndarray, hashes: np.ndarray) -> None:
    for p in positions(hashes, 8 * len(filt)):
        np.bitwise_or.at(filt, (p >> np.uint64(3)).astype(np.int64), (1 << (p & np.uint64(7))).astype(np.uint8))


def has(filt: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), dtype=bool)
    for p in positions(hashes, 8 * len(filt)):
        out &= (filt[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


class OnceTwice:
    """Two filters: hashes seen once at least, and those seen twice (or so it looks)."""

    def __init__(self, bits: int):
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        hashes, counts = np.unique(hashes, return_counts=True)
        again = (counts > 1) | has(self.once, hashes)
        add(self.twice, hashes[again])
        add(self.once, hashes)

    def slices(self) -> Iterator[tuple[int, bytes, bytes]]:
        for i in range(0, len(self.once), SLICE_BYTES):
            part = self.once[i : i + SLICE_BYTES]
            if part.any():
                yield i // SLICE_BYTES, zlib.compress(part.tobytes(), 1), zlib.compress(self.twice[i : i + SLICE_BYTES].tobytes(), 1)


SLICES = "slice int, once binary, twice binary"


def as_batches(filters: OnceTwice) -> Iterator[pa.RecordBatch]:
    for i, once, twice in filters.slices():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([once], pa.binary()), pa.array([twice], pa.binary())], ["slice", "once", "twice"])


def _merge(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An item in two partitions has its bits in both once-filters, hence in the
    conjunction: nothing seen twice is missed."""
    once = twice = None
    for frame in parts:
        for a, b in zip(frame["once"], frame["twice"], strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if once is None:
                once, twice = a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    yield pd.DataFrame({"slice": [key[0]], "once": [b""], "twice": [zlib.compress(twice.tobytes(), 1)]})


def twice_filter(slices: DataFrame, bits: int) -> np.ndarray:
    """The merged filter of what was seen twice; at most MOST_BITS come to the driver."""
    out = np.zeros(bits // 8, np.uint8)
    merged = slices.groupBy("slice").applyInPandas(_merge, SLICES)
    for row in merged.select("slice", "twice").toLocalIterator():
        part = np.frombuffer(zlib.decompress(bytes(row["twice"])), np.uint8)
        out[row["slice"] * SLICE_BYTES : row["slice"] * SLICE_BYTES + len(part)] = part
    return out


def member_filter(df: DataFrame, column: str, rows: int) -> np.ndarray:
    """A filter of the xxhash64 values in a long column (null-free)."""
    bits = bits_for(rows)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = OnceTwice(bits)
        for b in batches:
            hashes = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            add(filters.twice, hashes)
        filters.once = filters.twice
        yield from as_batches(filters)

    return twice_filter(df.select(column).mapInArrow(fill, SLICES), bits)
