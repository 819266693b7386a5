"""Words and word shingles of whole texts, in numpy over Arrow buffers.

A word is a run of bytes outside `\\x20` and `\\x09-\\x0D`. All work is vectorised over
groups of documents of about `GROUP_BYTES`; a longer document is cut at white space
into pieces whose word hashes are joined again, so memory stays in proportion to
the number of words rather than to some tens of times the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
GROUP_BYTES = 1 << 20
U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_STEP = [pow(0xC2B2AE3D27D4EB4F | 1, k, 1 << 64) for k in range(WIDTH)]


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i mod 2^64 for i < 2^bits, by doubling."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(1 << bits, U64)
        for k in range(bits):
            p[1 << k : 2 << k] = p[: 1 << k] * U64(pow(base, 1 << k, 1 << 64))
        out.append(p)
    return out[0], out[1]


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each lower-cased word of `raw`, and the index of its document."""
    n = len(raw)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    low = _LOWER[raw]
    inside = ~_SPACE[raw]
    begins = np.zeros(n + 1, bool)
    begins[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(max(10, int(n).bit_length()))
    total = np.zeros(n + 1, U64)
    np.cumsum(_TABLE[low] * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h += (end - start).astype(U64) * U64(0xA0761D6478BD642F)
    return mix(h), np.searchsorted(offs, start, side="right") - 1


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Cuts of a long text at white space, about GROUP_BYTES each."""
    at = 0
    while at < len(raw):
        to = min(len(raw), at + GROUP_BYTES)
        while to < len(raw):
            gap = np.flatnonzero(_SPACE[raw[to : to + GROUP_BYTES]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(len(raw), to + GROUP_BYTES)
        yield raw[at:to]
        at = to


def document_groups(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most GROUP_BYTES together, or one longer document."""
    n, at = len(offs) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + GROUP_BYTES, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For groups of documents: index of the first, and each one's sorted distinct shingle hashes.

    A shingle is five lower-cased words in a row. A text of one to four words has
    one shingle, the whole sequence; one without words has none.
    """
    raw, offs = text_bytes(column)
    for a, b in document_groups(offs):
        part = raw[offs[a] : offs[b]]
        if b == a + 1 and len(part) > GROUP_BYTES:
            hashes = np.concatenate([word_hashes(p, np.array([0, len(p)]))[0] for p in _pieces(part)])
            of = np.zeros(len(hashes), np.int64)
        else:
            hashes, of = word_hashes(part, offs[a : b + 1] - offs[a])
        counts = np.bincount(of, minlength=b - a)
        n = len(hashes)
        if n >= WIDTH:
            s = hashes[: n - WIDTH + 1].copy()
            for k in range(1, WIDTH):
                s += hashes[k : n - WIDTH + 1 + k] * U64(_STEP[k])
            s = mix(s)
        else:
            s = np.zeros(0, U64)
        first = np.concatenate([[0], np.cumsum(counts)])
        sets = []
        for d in range(b - a):
            c, f = int(counts[d]), int(first[d])
            if c >= WIDTH:
                sets.append(distinct(s[f : f + c - WIDTH + 1]))
            elif c:
                own = sum((int(h) * _STEP[k] for k, h in enumerate(hashes[f : f + c])), c * 0x632BE59BD9B4E019)
                sets.append(mix(np.array([own & 0xFFFFFFFFFFFFFFFF], U64)))
            else:
                sets.append(np.zeros(0, U64))
        yield a, sets


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    if len(x) > 1:
        keep = np.empty(len(x), bool)
        keep[0] = True
        np.not_equal(x[1:], x[:-1], out=keep[1:])
        x = x[keep]
    return x


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
