"""Tables of a fixed number of counts over a whole corpus: filled in the partitions, summed slice by slice in the cluster."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SLICE = 1 << 16
"""Counts in a slice; a table has a multiple of these."""
ROWS = "slice int, data binary"


def slices(table: np.ndarray) -> pa.RecordBatch:
    """The rows (slice, data) of a partition's table; slices without counts are left out."""
    parts = table.reshape(-1, SLICE)
    used = np.flatnonzero(parts.any(1))
    pack = zstandard.ZstdCompressor(1).compress
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([pack(parts[k].astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()) for k in used], pa.binary())], ["slice", "data"])


def _counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, SLICE * 8), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the partitions' tables of ``size`` counts, from their rows (slice, data).

    Each slice is summed as it streams by, so a task holds one slice whatever the number of partitions; the driver gets
    one row for each slice.
    """

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.zeros(SLICE, np.uint64)
        one = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), slices(held).column("data")], ["slice", "data"])
        for batch in batches:
            for k, data in zip(batch.column("slice").to_pylist(), batch.column("data").to_pylist()):
                if k != at:
                    if at is not None:
                        yield one()
                    at, held = k, np.zeros(SLICE, np.uint64)
                held += _counts(data)
        if at is not None:
            yield one()

    rows = parts.where("slice is not null").select("slice", "data").repartition("slice").sortWithinPartitions("slice")
    out = np.zeros(size, np.uint64)
    for k, data in rows.mapInArrow(total, ROWS).collect():  # size / SLICE rows
        out[k * SLICE : (k + 1) * SLICE] = _counts(bytes(data))
    return out


def bits_for(keys: int, least: int = 16, most: int = 26) -> int:
    """The size of a table for so many keys, as a power of two within fixed bounds."""
    return min(most, max(least, math.ceil(math.log2(max(1, keys)))))


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the Bloom filter lets each key pass: all that were put in, and rarely others."""
    one, two = _places(keys, len(table))
    return table[one] & table[two]


def _places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    mask = np.uint64(size - 1)
    return ((h >> np.uint64(32)) & mask).astype(np.int64), (h & mask).astype(np.int64)


def bloom(keys: DataFrame, expected: int) -> np.ndarray:
    """A Bloom filter of the bigint column ``key``, with about 16 places a key up to 2**26 places; beyond, more others pass."""
    size = 1 << bits_for(16 * expected)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.uint8)
        for batch in batches:
            for places in _places(batch.column("key").to_numpy().view(np.uint64), size):
                table[places] = 1
        yield slices(table)

    return summed(keys.select("key").mapInArrow(fill, ROWS), size) > 0
