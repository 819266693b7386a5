"""A table of 256 random words for rolling hashes, derived by rule.

gear(b) is the number in the first 16 hex digits of the SHA-256 of b's decimal
form; its low 32 bits are digits 9 to 16. So Spark, DuckDB and numpy agree on it.
"""

from __future__ import annotations

import hashlib

import numpy as np

GEAR64 = np.array([int(hashlib.sha256(str(b).encode()).hexdigest()[:16], 16) for b in range(256)], np.uint64)
GEAR32 = GEAR64 & np.uint64(0xFFFFFFFF)


def rolling(data: np.ndarray, width: int, shift: int = 1) -> np.ndarray:
    """Per byte the sum of gear values of the last `width` bytes, each `shift` bits higher than the one after it, mod 2^64."""
    values = GEAR64[data]
    out, size = values.copy(), 1
    # by doubling: the sum over twice as many bytes, and one more where the width has that bit
    for bit in bin(width)[3:]:
        out[size:] += out[:-size] << np.uint64(size * shift) if size < len(out) else np.uint64(0)
        size *= 2
        if bit == "1":
            out[1:] = values[1:] + (out[:-1] << np.uint64(shift))
            size += 1
    return out
