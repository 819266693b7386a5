"""Spectral similarity hash of a byte string: 32 bits from byte and byte-pair frequencies.

Bytes are ranked by falling frequency, then by value, and so are pairs of adjacent bytes.
C: the eight widest gaps between neighbouring ranks cut the ranking into blocks, whose bytes are
XORed. F: the leading bits of the sixteen highest frequencies. P: the pairs of ranks five to
eight. The hash is C ^ F ^ P.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.batches import map_batches

# Fixed values of the hash.
C_BLOCKS, C_LEAST_GAP, C_LEAST_COUNT = 8, 1, 50
F_BITS, F_SHIFTS = 3, (0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 6)
P_RANKS, P_SHIFT = range(5, 9), 20


def byte_histogram(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte values that occur, and how often, by rank."""
    count = np.bincount(data, minlength=256)
    order = np.argsort(-count, kind="stable")
    order = order[: np.count_nonzero(count)]
    return order, count[order]


def pair_histogram(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of adjacent bytes as 256 * first + second, and how often, by rank."""
    pair, count = np.unique(data[:-1].astype(np.int64) * 256 + data[1:], return_counts=True)
    order = np.argsort(-count, kind="stable")
    return pair[order], count[order]


def c_part(byte: np.ndarray, count: np.ndarray) -> int:
    gap = (count[:-1] - count[1:]) * np.arange(1, len(count))
    fit = np.flatnonzero((gap >= C_LEAST_GAP) & (count[1:] >= C_LEAST_COUNT))
    ends = np.sort(fit[np.argsort(-gap[fit], kind="stable")][:C_BLOCKS])
    folded = np.bitwise_xor.accumulate(byte)[ends] if len(ends) else np.zeros(0, np.int64)
    blocks = folded ^ np.concatenate([[0], folded[:-1]]) if len(ends) else folded
    return int(np.bitwise_xor.reduce(blocks.astype(np.int64) << (3 * (C_BLOCKS - np.arange(len(ends)))))) if len(ends) else 0


def f_part(count: np.ndarray) -> int:
    out = 0
    for n, shift in zip(count.tolist(), F_SHIFTS, strict=False):
        wide = n << F_BITS
        out ^= (wide >> (wide.bit_length() - 1 - F_BITS) & (1 << F_BITS) - 1) << shift
    return out


def fold_pair(first: int, second: int) -> int:
    """Both bytes rotated by three bits, left and right, and overlapped to twelve bits."""
    return ((first << 3 | first >> 5) & 255) << 4 ^ (second >> 3 | second << 5) & 255


def p_part(pair: np.ndarray) -> int:
    out = 0
    for x in pair[P_RANKS.start : P_RANKS.stop].tolist():
        out ^= fold_pair(*divmod(x, 256)) << P_SHIFT
    return out


def spectra(data: bytes) -> tuple[int, int, int]:
    """(C, F, P); all 0 for an empty string."""
    if not data:
        return 0, 0, 0
    raw = np.frombuffer(data, np.uint8)
    byte, count = byte_histogram(raw)
    return c_part(byte, count), f_part(count), p_part(pair_histogram(raw)[0])


def spectral_hash(data: bytes) -> int:
    c, f, p = spectra(data)
    return c ^ f ^ p


def neighbour_hashes(sim_hash: Column) -> tuple[Column, Column]:
    """The next and the last hash; both stop at the ends of 32 bits."""
    return F.least(sim_hash + 1, F.lit(0xFFFFFFFF)), F.greatest(sim_hash - 1, F.lit(0)).cast("long")


def with_spectra(items: DataFrame, content: str = "content") -> DataFrame:
    """Adds c_spectrum, f_spectrum, p_spectrum and sim_hash of a binary column; null gives null."""
    names = ["c_spectrum", "f_spectrum", "p_spectrum", "sim_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if x is None else spectra(x) for x in batch.column(content).to_pylist()]
            rows = [(None,) * 4 if r is None else (*r, r[0] ^ r[1] ^ r[2]) for r in rows]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *names])

    schema = T.StructType([*items.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    return map_batches(items, run, schema)


def _histogram(items: DataFrame, keys: list[str], count, schema: str) -> DataFrame:
    """A row per item and value; the content column is the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [count(np.frombuffer(x or b"", np.uint8)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            times = [len(f[0]) for f in found]
            own = [batch.column(c).take(pa.array(np.repeat(np.arange(batch.num_rows), times))) for c in range(batch.num_columns - 1)]
            value, n = (np.concatenate([f[k] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*own, pa.array(value), pa.array(n)], [*keys, "value", "n"])

    return map_batches(items, run, schema)


def byte_counts(items: DataFrame) -> DataFrame:
    """item_id, value, n for items (item_id, content)."""
    return _histogram(items.select("item_id", "content"), ["item_id"], byte_histogram, "item_id long, value long, n long")


def pair_counts(items: DataFrame) -> DataFrame:
    """item_id, value (256 * first + second), n for items (item_id, content)."""
    return _histogram(items.select("item_id", "content"), ["item_id"], pair_histogram, "item_id long, value long, n long")
