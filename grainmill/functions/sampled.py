"""Sampled-gear sketch: three minima over the positions where a rolling hash ends in zero bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from grainmill.batches import map_batches
from grainmill.functions.gear import rolling

#: The multipliers of the three features: the first 16 hex digits of the SHA-256 of "feature 0" and so on, made odd.
FACTORS = tuple(int(hashlib.sha256(f"feature {k}".encode()).hexdigest()[:16], 16) | 1 for k in range(3))
LOW32 = np.uint64(0xFFFFFFFF)


def sketch(data: bytes, bits: int = 7) -> list[int] | None:
    """The features, or None where no byte is sampled."""
    raw = np.frombuffer(data, np.uint8)
    fp = rolling(raw, 32) & LOW32
    at = np.flatnonzero(fp & np.uint64((1 << bits) - 1) == 0)
    if not len(at):
        return None
    return [int((fp[at] * (np.uint64(c) & LOW32) + raw[at] & LOW32).min()) for c in FACTORS]


def neighbours(features: list[int] | None) -> list[list[int]]:
    """The next and the last sketch, as a counter of three 64-bit digits that stops at its ends."""
    if features is None:
        return []
    value = sum(f << 64 * k for k, f in enumerate(reversed(features)))
    ends = min(value + 1, (1 << 192) - 1), max(value - 1, 0)
    return [[v >> 64 * k & (1 << 64) - 1 for k in (2, 1, 0)] for v in ends]


def with_sketch(items: DataFrame, content: str = "content", bits: int = 7) -> DataFrame:
    """Adds features, an array of three longs or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if x is None else sketch(x, bits) for x in batch.column(content).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "features"])

    return map_batches(items, run, T.StructType([*items.schema.fields, T.StructField("features", T.ArrayType(T.LongType()))]))


def with_neighbours(items: DataFrame) -> DataFrame:
    """Adds next and last, the sketches beside features, as arrays of three longs; null where features is."""

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [neighbours(x) for x in batch.column("features").to_pylist()]
            cols = [pa.array([[signed(d) for d in f[k]] if f else None for f in found], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "next", "last"])

    return map_batches(items, run, T.StructType([*items.schema.fields, *(T.StructField(n, T.ArrayType(T.LongType())) for n in ("next", "last"))]))
