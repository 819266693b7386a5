"""Delta codes of a byte string against a parent, and their decoders.

Copy and insert instructions have little-endian headers: INSERT is a 3-byte length with bit 23
set and the bytes, COPY a 3-byte length and a 3-byte offset into the parent. The gear-word,
sub-chunk and block encoders differ in how they find what to copy. The edit script lists
single-byte edits; the LZ code mixes literals and matches near moving pointers and may be
packed by a static prefix code. Every encoder is lossless for all inputs. Copies have 24 bits for
places, so what a parent has beyond 16 MiB isn't copied from. A code that isn't shorter than the
data is given up for the data itself.
"""

from __future__ import annotations

import math
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import zstandard

from grainmill.functions.gear import rolling
from grainmill.operators.chunking import gear_cuts

WORD, LONGEST, INSERT = 16, (1 << 23) - 1, 1 << 23
SUB_BITS = 13
#: Places up to which the block code tries each; of more, the order of suffixes gives the same run.
FEW = 64


class RawFallback(Exception):
    """The encoder declines: the code wouldn't be shorter than the data."""


class CodeError(ValueError):
    """A malformed code; kind is flag, length, offset or action."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def _insert(data: bytes) -> bytes:
    return b"".join((len(p) | INSERT).to_bytes(3, "little") + p for p in (data[i : i + LONGEST] for i in range(0, len(data), LONGEST)))


def _copy(start: int, size: int) -> bytes:
    return b"".join(min(LONGEST, size - i).to_bytes(3, "little") + (start + i).to_bytes(3, "little") for i in range(0, size, LONGEST))


def decode_copies(parent: bytes, code: bytes) -> bytes:
    out, at = [], 0
    while at < len(code):
        size = int.from_bytes(code[at : at + 3], "little")
        if size & INSERT:
            size -= INSERT
            out.append(code[at + 3 : at + 3 + size])
            at += 3 + size
        else:
            start = int.from_bytes(code[at + 3 : at + 6], "little")
            if start + size > len(parent):
                raise CodeError("offset", "a copy reaches past the parent")
            out.append(parent[start : start + size])
            at += 6
    return b"".join(out)


def _run(a: bytes, i: int, b: bytes, j: int) -> int:
    """Length of the common run from a[i] and b[j]."""
    n, most, step = 0, min(len(a) - i, len(b) - j), 64
    while n < most:
        size = min(step, most - n)
        x, y = a[i + n : i + n + size], b[j + n : j + n + size]
        if x != y:
            differs = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
            return n + ((differs & -differs).bit_length() - 1 >> 3)
        n, step = n + size, step * 4
    return n


def _addressable(parent: bytes) -> bytes:
    return parent[: 1 << 24]


@lru_cache(maxsize=1)
def _word_index(parent: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 16-byte words of the parent, sorted, with each one's last position."""
    hashes = rolling(np.frombuffer(parent, np.uint8), WORD, 4)[WORD - 1 :]
    keys, last = np.unique(hashes[::-1], return_index=True)
    return keys, len(hashes) - 1 - last


def encode_gearword(child: bytes, parent: bytes) -> bytes:
    """Copies greedily from the last place where the parent has the same 16-byte word."""
    parent = _addressable(parent)
    if len(child) < WORD or len(parent) < WORD:
        return _insert(child)
    keys, places = _word_index(parent)
    hashes = rolling(np.frombuffer(child, np.uint8), WORD, 4)[WORD - 1 :]
    k = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    found = np.flatnonzero(keys[k] == hashes)
    out, done, at = [], 0, 0
    while at < len(found):
        i = int(found[at])
        size = _run(child, i, parent, int(places[k[i]]))
        if size < WORD:
            at += 1
            continue
        out += [_insert(child[done:i]), _copy(int(places[k[i]]), size)]
        done = i + size
        at = int(np.searchsorted(found, done))
    return b"".join([*out, _insert(child[done:])])


def _pieces(data: bytes) -> list[tuple[int, int]]:
    cuts = sorted({0, *gear_cuts(data, SUB_BITS).tolist(), len(data)}) if data else [0]
    return list(zip(cuts, cuts[1:], strict=False))


def encode_subchunk(child: bytes, parent: bytes, mode: str = "plain") -> bytes:
    """Copies whole content-defined pieces that the parent has too.

    speed and compression extend a matched piece byte by byte over what follows;
    compression also remembers the extended match for later pieces of this child.
    """
    parent = _addressable(parent)
    index: dict[bytes, int] = {}
    for a, b in _pieces(parent):
        index.setdefault(parent[a:b], a)
    out, done = [], 0
    for a, b in _pieces(child):
        lo = max(a, done)
        if lo >= b:
            continue
        place = index.get(child[lo:b])
        if place is None:
            out.append(_insert(child[lo:b]))
            done = b
        else:
            size = b - lo if mode == "plain" else _run(child, lo, parent, place)
            out.append(_copy(place, size))
            done = lo + size
            if mode == "compression":
                index.setdefault(child[lo:done], place)
    return b"".join(out)


@lru_cache(maxsize=1)
def _suffixes(parent: bytes) -> np.ndarray:
    """Places of the parent in the order of what follows them, by ranks of doubled lengths."""
    rank, size = np.frombuffer(parent, np.uint8).astype(np.int64) + 1, 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[: len(rank) - size] = rank[size:]
        key = rank * (len(rank) + 257) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        rank[order] = np.cumsum(new)
        size *= 2
        if new.all() or size >= len(rank):
            return order


def _longest(child: bytes, i: int, parent: bytes) -> tuple[int, int]:
    """The longest run from child[i] among all places of the parent, and minus the first place that has it."""
    order = _suffixes(parent)

    def before(p: int) -> bool:
        n = _run(child, i, parent, p)
        return i + n < len(child) and (p + n == len(parent) or parent[p + n] < child[i + n])

    k = bisect_left(order, True, key=lambda p: not before(int(p)))
    size = max(_run(child, i, parent, int(p)) for p in order[max(0, k - 1) : k + 1])
    want = child[i : i + size]
    lo = bisect_left(order, want, key=lambda p: parent[p : p + size])
    hi = bisect_right(order, want, lo=lo, key=lambda p: parent[p : p + size])
    return size, -int(order[lo:hi].min())


def encode_block(child: bytes, parent: bytes) -> bytes:
    """Copies the longest run among all places of the next 16-byte block."""
    parent = _addressable(parent)
    if len(child) < WORD or len(parent) < WORD:
        return _insert(child)
    keys = rolling(np.frombuffer(parent, np.uint8), WORD, 4)[WORD - 1 :]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    hashes = rolling(np.frombuffer(child, np.uint8), WORD, 4)[WORD - 1 :]
    first = np.searchsorted(keys, hashes)
    found = np.flatnonzero(keys[np.minimum(first, len(keys) - 1)] == hashes)
    last = np.searchsorted(keys, hashes[found], "right")
    out, done, at = [], 0, 0
    while at < len(found):
        i = int(found[at])
        word = child[i : i + WORD]
        places = [p for p in order[first[i] : last[at]].tolist() if parent[p : p + WORD] == word]
        if not places:
            at += 1
            continue
        size, place = max((_run(child, i, parent, p), -p) for p in places) if len(places) <= FEW else _longest(child, i, parent)
        out += [_insert(child[done:i]), _copy(-place, size)]
        done = i + size
        at = int(np.searchsorted(found, done))
    return b"".join([*out, _insert(child[done:])])


# Fixed values of the edit script: actions in bits 30 and 31, the byte, and the index below 2^22.
REPLACE, ADD, DELETE = 0, 1, 2
MOST_DIFFERENCE = 4000


def _columns(a: bytes, b: bytes) -> Callable[[int, int, int, int], Iterator[tuple[int, int, int]]]:
    """Runs over columns of the matrix of edit distances, each a whole number with a bit for each byte of `a`.

    From the bits where a column grows and falls it gives, per byte of b, those where the cell equals the one
    before it on the diagonal, and the new two.
    """
    left, mask = np.frombuffer(a, np.uint8), (1 << len(a)) - 1
    places = {x: int.from_bytes(np.packbits(left == x, bitorder="little").tobytes(), "little") for x in set(b)}

    def run(up: int, down: int, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        for x in b[lo:hi]:
            met = places[x] | down
            same = ((((met & up) + up) ^ up) | met) & mask
            falls, grows = up & same, down | mask ^ (up | same)
            shifted = (grows << 1 | 1) & mask
            down = shifted & same
            up = (falls << 1 | mask ^ (shifted | same)) & mask
            yield same, up, down

    return run


def _edit_steps(a: bytes, b: bytes, most: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Parts of the matrix from its last columns to the first: where each begins, and per column the bits that
    tell the way back. Only the first column of a part is kept on the way there; declines at a distance above `most`.
    """
    run, part = _columns(a, b), max(64, math.isqrt(len(b)))
    starts, up, down = [], (1 << len(a)) - 1, 0
    for lo in range(0, len(b), part):
        starts.append((lo, up, down))
        hi = min(lo + part, len(b))
        for _, up, down in run(up, down, lo, hi):  # noqa: B007
            pass
        # distances never fall along a diagonal, and this one ends in the last cell
        on = (1 << max(0, len(a) - len(b) + hi)) - 1
        if len(a) - len(b) + hi >= 0 and hi + (up & on).bit_count() - (down & on).bit_count() > most:
            raise RawFallback
    if not b and len(a) > most:
        raise RawFallback
    for lo, up, down in reversed(starts):
        yield lo, [(same, grown) for same, grown, _ in run(up, down, lo, lo + part)]


def _back(a: bytes, i: int, b: bytes, j: int) -> int:
    """Length of the common run that ends before a[i] and b[j]."""
    n, most, step = 0, min(i, j), 64
    while n < most:
        size = min(step, most - n)
        x, y = a[i - n - size : i - n], b[j - n - size : j - n]
        if x != y:
            return n + size - ((int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_length() + 7 >> 3)
        n, step = n + size, step * 4
    return n


def _furthest(a: bytes, b: bytes, most: int) -> list[dict[int, int]] | None:
    """Per number of edits up to the distance and per diagonal (place in b less that in a) the furthest place in `a` that they reach;
    nothing where the distance is above `most`. The time is that of most * most runs.
    """
    out = [{0: _run(a, 0, b, 0)}]
    end = len(b) - len(a)
    while out[-1].get(end, -1) < len(a):
        if len(out) > most:
            return None
        last, now = out[-1], {}
        for k in range(max(-len(out), -len(a)), min(len(out), len(b)) + 1):
            i = min(max(last.get(k, -2) + 1, last.get(k - 1, -1), last.get(k + 1, -2) + 1), len(a), len(b) - k)
            now[k] = i + _run(a, i, b, i + k)
        out.append(now)
    return out


def _few_edits(a: bytes, b: bytes, reached: list[dict[int, int]]) -> tuple[list[tuple[int, int, int]], int, int]:
    """(edits, i, j): the edits back from both ends to a[i] and b[j], one of which is the start; the same that the whole matrix gives.

    A cell's distance is the least number of edits that reach its place on its diagonal.
    """
    out, i, j, e = [], len(a), len(b), len(reached) - 1
    while i and j:
        n = _back(a, i, b, j)
        if n:
            i, j = i - n, j - n
            continue
        k, fewer = j - i, reached[e - 1]
        if fewer.get(k, -1) >= i - 1:
            i, j = i - 1, j - 1
            out.append((REPLACE, b[j], i))
        elif fewer.get(k + 1, -1) >= i - 1:
            i -= 1
            out.append((DELETE, 0, i))
        else:
            j -= 1
            out.append((ADD, b[j], i))
        e -= 1
    return out, i, j


def _many_edits(a: bytes, b: bytes, most: int, head: int) -> tuple[list[int], int, int]:
    """The edits, packed, by the whole matrix, and where they leave both."""
    out, i, j = [], len(a), len(b)
    for at, steps in _edit_steps(a, b, most):
        while i and j > at:
            same, less = steps[j - at - 1]
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
            elif not same >> i - 1 & 1:
                i, j = i - 1, j - 1
                out.append(REPLACE << 30 | b[j] << 22 | head + i)
            elif less >> i - 1 & 1:
                i -= 1
                out.append(DELETE << 30 | head + i)
            else:
                j -= 1
                out.append(ADD << 30 | b[j] << 22 | head + i)
    return out, i, j


def encode_editscript(child: bytes, parent: bytes) -> bytes:
    """Edits that turn the parent into the child, from the end to the start; declines where raw is shorter."""
    if abs(len(child) - len(parent)) > MOST_DIFFERENCE:
        raise RawFallback
    head = _run(child, 0, parent, 0)
    tail = _run(child[head:][::-1], 0, parent[head:][::-1], 0)
    a, b = parent[head : len(parent) - tail], child[head : len(child) - tail]
    if len(parent) >= 1 << 22:
        raise RawFallback
    most = (max(len(child), 4) - 4) // 4
    few = math.isqrt(len(a)) // 16 + 4
    reached = _furthest(a, b, min(few, most))
    if reached is not None:
        edits, i, j = _few_edits(a, b, reached)
        out = [action << 30 | byte << 22 | head + at for action, byte, at in edits]
    elif few >= most:
        raise RawFallback
    else:
        out, i, j = _many_edits(a, b, most, head)
    out += [DELETE << 30 | head + k for k in range(i - 1, -1, -1)]
    out += [ADD << 30 | b[k] << 22 | head for k in range(j - 1, -1, -1)]
    return struct.pack(f">{len(out)}I", *out)


def decode_editscript(parent: bytes, code: bytes) -> bytes:
    out = bytearray(parent)
    for (x,) in struct.iter_unpack(">I", code):
        action, byte, at = x >> 30, x >> 22 & 255, x & (1 << 22) - 1
        if action == REPLACE:
            out[at] = byte
        elif action == ADD:
            out.insert(at, byte)
        elif action == DELETE:
            del out[at]
        else:
            raise CodeError("action", "unknown action")
    return bytes(out)


# Fixed values of the LZ code: kinds of pointers in a flag's remainder, and sizes.
LOCAL, MAIN_AFTER, MAIN_BEFORE, AUX_AFTER, AUX_BEFORE = range(5)
LZ_LEAST, LZ_MOST, LZ_CHAIN, LZ_FAR, LZ_NEAR = 3, 1026, 1024, 4096, 256


def lz_flag(size: int, kind: int) -> tuple[int, int]:
    """A match's flag and the rest of its length."""
    times, rest = divmod(size - LZ_LEAST, 256)
    if not 0 <= times <= 3:
        raise CodeError("length", "a match has 3 to 1026 bytes")
    return 1 + 5 * times + kind, rest


def lz_unflag(flag: int, rest: int) -> tuple[int, int]:
    """The size and kind of a match."""
    if not 1 <= flag <= 20:
        raise CodeError("flag", "no such flag")
    times, kind = divmod(flag - 1, 5)
    return LZ_LEAST + 256 * times + rest, kind


def _moved(main: int, aux: int, end: int, used_main: bool, far: bool, first: bool) -> tuple[int, int]:
    """Pointers after a match: the used one follows it, but after a far jump the other one does."""
    return (end, aux) if used_main == (first or not far) else (main, end)


def _words(data: np.ndarray) -> np.ndarray:
    """At each place the next 8 bytes as a number, the first highest; zeros stand for what is beyond the end."""
    out = np.zeros(len(data), np.uint64)
    for k in range(min(8, len(data))):
        out[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def _same_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes of the words are equal."""
    differs = a ^ b
    out = np.zeros(len(a), np.int64)
    for k in range(8):
        out += differs < np.uint64(1 << 8 * (8 - k) - 8) if k < 7 else differs == 0
    return out


def _numbers(x: np.ndarray) -> list[int] | memoryview:
    """To be read one by one: all as a list, or where few of many may be read, a view."""
    return x.tolist() if len(x) < 1 << 14 else memoryview(x)


def _own(child: bytes) -> tuple[list[int] | memoryview, list[int] | memoryview]:
    """For each place of three bytes the last one before it, not overlapping, that has the same three, or -1; and how many bytes
    are the same, none overlapping, up to 8.
    """
    words = _words(np.frombuffer(child, np.uint8))
    n = len(child) - 2
    keys = np.sort(words[:n] >> np.uint64(40) << np.uint64(40) | np.arange(n, dtype=np.uint64))
    heads, order, before = keys >> np.uint64(40), (keys & np.uint64((1 << 40) - 1)).astype(np.int64), np.full(n, -1)
    for k in (3, 2, 1):
        # the k-th place before it of the same bytes; the third is never too near
        near = (heads[k:] == heads[:-k]) & (order[k:] - order[:-k] >= 3)
        before[order[k:][near]] = order[:-k][near]
    at = np.arange(n)
    before[at - before > 0xFFFF] = -1
    size = np.minimum(np.minimum(_same_bytes(words[:n], words[before]), at - before), len(child) - at)
    size[before < 0] = 0
    return _numbers(before), _numbers(size)


class _Places:
    """Where a parent has what comes next in a child: its places in the order of their next 8 bytes.

    A place takes part if it is among the first LZ_CHAIN of its three bytes.
    """

    def __init__(self, child: bytes, parent: bytes):
        self.child, self.parent = child, parent
        words, n = _words(np.frombuffer(parent, np.uint8)), len(parent) - 2
        order = np.argsort(words[:n])
        words = words[order]
        if n > LZ_CHAIN:
            heads = words >> np.uint64(40)
            start = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
            size = np.diff(np.append(start, n))
            keep = np.ones(n, bool)
            for a, k in zip(start[size > LZ_CHAIN].tolist(), size[size > LZ_CHAIN].tolist(), strict=True):
                keep[a : a + k][np.argsort(order[a : a + k])[LZ_CHAIN:]] = False
            order, words = order[keep], words[keep]
        wanted = _words(np.frombuffer(child, np.uint8))[: len(child) - 2]
        at = np.searchsorted(words, wanted)
        above = _same_bytes(words[np.minimum(at, len(words) - 1)], wanted)
        above[at == len(words)] = 0
        below = _same_bytes(words[np.maximum(at - 1, 0)], wanted)
        below[at == 0] = 0
        self.order, self.sorted = _numbers(order), order
        self.next = _numbers(_same_bytes(words[1:], words[:-1]))
        self.at, size = _numbers(at - (above < below)), np.maximum(above, below)
        # the last words end in zeros that are not there
        self.size = _numbers(np.minimum(size, np.arange(len(child), 2, -1)))

    def _range(self, k: int, size: int) -> tuple[int, int]:
        """The places that share `size` bytes with the k-th."""
        lo, hi, step = k, k + 1, self.next
        while lo and step[lo - 1] >= size:
            lo -= 1
        while hi <= len(step) and step[hi - 1] >= size:
            hi += 1
        return lo, hi

    def best(self, i: int, main: int, aux: int) -> tuple[int, int, int, int] | None:
        """(score, size, distance, place) of the best match with child[i:]: the longest, one less if it is far; then the nearest, then the first."""
        size, found = self.size[i], None
        # zeros behind the parent's end may have been counted, and of matches as long one nearer may be a byte shorter
        while size >= LZ_LEAST and (found is None or found[1] < size + 1 or (found[2] > LZ_FAR and found[1] == size + 1)):
            found = self._extended(i, *self._range(self.at[i], size), main, aux)
            size -= 1
        return found

    def nearest(self, i: int, main: int, aux: int) -> tuple[int, int]:
        """(distance, place) of the nearest of the longest matches with child[i:], which have fewer than 8 bytes."""
        order, step, size = self.order, self.next, self.size[i]
        lo = hi = self.at[i]
        while lo and step[lo - 1] >= size:
            lo -= 1
        while hi < len(step) and step[hi] >= size:
            hi += 1
        if hi - lo > 24:
            places = self.sorted[lo : hi + 1]
            off = np.minimum(np.abs(places - main), np.abs(places - aux))
            d = int(off.min())
            return d, int(places[off == d].min())
        d, at = 1 << 62, 0
        for p in order[lo : hi + 1]:
            e, f = p - main if p >= main else main - p, p - aux if p >= aux else aux - p
            if f < e:
                e = f
            if e < d or (e == d and p < at):
                d, at = e, p
        return d, at

    def _extended(self, i: int, lo: int, hi: int, main: int, aux: int) -> tuple[int, int, int, int] | None:
        """Of places with matches of any size."""
        child, parent, best = self.child, self.parent, None
        near = [(min(abs(p - main), abs(p - aux)), p) for p in self.order[lo:hi]]
        for d, p in sorted(near):
            if d > 0xFFFF:
                break
            # it is no nearer than the best
            if best is not None and child[i : i + best[1] + 1] != parent[p : p + best[1] + 1]:
                continue
            size = min(_run(child, i, parent, p), LZ_MOST)
            score = (size - (d > LZ_FAR)) << 16 | 0xFFFF - d
            if size >= LZ_LEAST and (best is None or score > best[0]):
                best = score, size, d, p
                if size == LZ_MOST:
                    break
        return best


def lz_symbols(child: bytes, parent: bytes, most: int | None = None) -> bytes:
    """Literals [0, byte] and matches [flag, rest, high, low] of a distance to a pointer; declines where there are `most` bytes of them.

    A match may also be with what the child itself has last had before, at a distance back from there.
    """
    n, out = len(child), bytearray()
    i, main, aux, last = 0, 0, 0, None
    most = 1 << 62 if most is None else most
    before, own_size = _own(child) if n > 2 else ([], [])
    places = _Places(child, parent) if n > 2 and len(parent) > 2 else None
    sizes, zeros = places.size if places is not None else [0] * n, 0 in child
    while i < n:
        own, size = (own_size[i], sizes[i]) if i + 2 < n else (0, 0)
        if size < LZ_LEAST and not own:
            out.append(0)
            out.append(child[i])
            i += 1
        else:
            p, off = before[i], i - before[i]
            if own < 8 and size < 8 and not zeros:
                worth = own - (off > LZ_FAR)
                if size < LZ_LEAST or (own and worth > size):
                    size, p = own, None
                else:
                    d, at = places.nearest(i, main, aux)
                    if d > LZ_FAR:
                        size, off, p = _best(child, i, p, places, main, aux)
                    elif own and worth == size and off < d:
                        p = None
                    else:
                        off, p = d, at
            else:
                size, off, p = _best(child, i, p, places, main, aux)
            if size < LZ_LEAST:
                out.append(0)
                out.append(child[i])
                i += 1
            else:
                if p is None:
                    kind = LOCAL
                else:
                    used_main = abs(p - main) <= abs(p - aux)
                    kind = (MAIN_AFTER if used_main else AUX_AFTER) + (p < (main if used_main else aux))
                    far = off >= LZ_NEAR or (last is not None and last >= LZ_NEAR)
                    main, aux = _moved(main, aux, p + size, used_main, far, last is None)
                    last = off
                times, rest = divmod(size - LZ_LEAST, 256)
                out += bytes((1 + 5 * times + kind, rest, off >> 8, off & 255))
                i += size
        if len(out) >= most:
            raise RawFallback
    return bytes(out)


def _best(child: bytes, i: int, p: int, places: _Places | None, main: int, aux: int) -> tuple[int, int, int | None]:
    """(size, distance, place) of the best match, of size 0 if there is none; the place is null in the child itself, where p is the last one."""
    best = places.best(i, main, aux) if places is not None else None
    if p >= 0:
        size = min(_run(child, i, child, p), i - p, LZ_MOST)
        score = (size - (i - p > LZ_FAR)) << 16 | 0xFFFF - (i - p)
        if size >= LZ_LEAST and (best is None or score > best[0]):
            return size, i - p, None
    return best[1:] if best is not None else (0, 0, None)


def lz_restore(parent: bytes, symbols: bytes, permissive: bool = False) -> bytes:
    """The data of a list of symbols. permissive: a symbol that can't be right is passed over, and an end cut off left out."""
    out, at, main, aux, last = bytearray(), 0, 0, 0, None
    while at < len(symbols):
        if symbols[at] == 0:
            out += symbols[at + 1 : at + 2]
            at += 2
            continue
        symbol, at = symbols[at : at + 4], at + 4
        try:
            if len(symbol) < 4:
                raise CodeError("length", "a match is cut off")
            size, kind = lz_unflag(symbol[0], symbol[1])
            off = symbol[2] << 8 | symbol[3]
            if kind == LOCAL:
                start = len(out) - off
                if not 0 <= start <= len(out) - size:
                    raise CodeError("offset", "a match reaches outside the output")
                out += out[start : start + size]
                continue
            used_main = kind in (MAIN_AFTER, MAIN_BEFORE)
            start = (main if used_main else aux) + (-off if kind in (MAIN_BEFORE, AUX_BEFORE) else off)
            if not 0 <= start <= len(parent) - size:
                raise CodeError("offset", "a match reaches outside the parent")
        except CodeError:
            if not permissive:
                raise
            continue
        out += parent[start : start + size]
        far = off >= LZ_NEAR or (last is not None and last >= LZ_NEAR)
        main, aux = _moved(main, aux, start + size, used_main, far, last is None)
        last = off
    return bytes(out)


@lru_cache(maxsize=1)
def prefix_code() -> tuple[list[int], list[int]]:
    """Canonical code words and their lengths: symbols below 128 weigh 20, others 5; ties by symbol."""
    heap = [(20 if s < 128 else 5, s, (s,)) for s in range(256)]
    heapify(heap)
    size = [0] * 256
    while len(heap) > 1:
        (w, k, a), (v, m, b) = heappop(heap), heappop(heap)
        for s in (*a, *b):
            size[s] += 1
        heappush(heap, (w + v, min(k, m), a + b))
    words, code, last = [0] * 256, 0, 0
    for s in sorted(range(256), key=lambda s: (size[s], s)):
        code <<= size[s] - last
        words[s], last = code, size[s]
        code += 1
    return words, size


@lru_cache(maxsize=1)
def _prefix_tables() -> tuple[list[str], int, list[tuple[int, int]]]:
    """The code words as strings of bits, the longest one's length, and the symbol and length for each number of so many bits."""
    words, size = prefix_code()
    long = max(size)
    table = [(0, 0)] * (1 << long)
    for s in range(256):
        low = words[s] << long - size[s]
        table[low : low + (1 << long - size[s])] = [(s, size[s])] * (1 << long - size[s])
    return [f"{words[s]:0{size[s]}b}" for s in range(256)], long, table


def pack_symbols(symbols: bytes) -> bytes:
    """A 4-byte count and the symbols' code words."""
    words = _prefix_tables()[0]
    bits = "".join([words[s] for s in symbols])
    bits += "0" * (-len(bits) % 8)
    return struct.pack("<I", len(symbols)) + (int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b"")


def unpack_symbols(code: bytes, permissive: bool = False) -> bytes:
    _, long, table = _prefix_tables()
    if len(code) < 4:
        if permissive:
            return b""
        raise CodeError("length", "the code ends early")
    (count,), out, held, n = struct.unpack_from("<I", code), bytearray(), 0, 0
    for at in range(4, len(code), 32):
        part = code[at : at + 32]
        held, n = held << 8 * len(part) | int.from_bytes(part, "big"), n + 8 * len(part)
        if at + 32 >= len(code):
            held, n = held << long, n + long  # zeros, so that the last words are looked up like the others
        while n > 2 * long or (at + 32 >= len(code) and n > long):
            s, size = table[held >> n - long & (1 << long) - 1]
            if at + 32 >= len(code) and n - size < long:
                break
            n -= size
            out.append(s)
            if len(out) == count:
                return bytes(out)
        held &= (1 << n) - 1
    if len(out) < count and not permissive:
        raise CodeError("length", "the code ends early")
    return bytes(out)


ENCODERS: dict[str, Callable[[bytes, bytes], bytes]] = {
    "gearword": encode_gearword,
    "subchunk": encode_subchunk,
    "subchunk_speed": lambda c, p: encode_subchunk(c, p, "speed"),
    "subchunk_compression": lambda c, p: encode_subchunk(c, p, "compression"),
    "block": encode_block,
    "editscript": encode_editscript,
    "lz_raw": lz_symbols,
    "lz": lambda c, p: pack_symbols(lz_symbols(c, p)),
}
#: The same, which decline as soon as the code can't be shorter than the data; a code word has 7 bits at least.
LZ_BOUNDS: dict[str, Callable[[bytes, bytes], bytes]] = {
    "lz_raw": lambda c, p: lz_symbols(c, p, max(1, len(c))),
    "lz": lambda c, p: pack_symbols(lz_symbols(c, p, len(c) * 8 // min(prefix_code()[1]) + 1)),
}
DECODERS: dict[str, Callable[[bytes, bytes], bytes]] = {
    **dict.fromkeys(("gearword", "subchunk", "subchunk_speed", "subchunk_compression", "block"), decode_copies),
    "editscript": decode_editscript,
    "lz_raw": lz_restore,
    "lz": lambda p, d: lz_restore(p, unpack_symbols(d)),
}
#: Decoders that pass over what is malformed.
PERMISSIVE: dict[str, Callable[[bytes, bytes], bytes]] = {
    "lz_raw": lambda p, d: lz_restore(p, d, True),
    "lz": lambda p, d: lz_restore(p, unpack_symbols(d, True), True),
}


def encode(codec: str, child: bytes, parent: bytes, compress: bool = False) -> tuple[str, bytes]:
    """(kind, payload): a delta, or simple with the data itself where the codec declines or its code isn't shorter."""
    try:
        if codec in LZ_BOUNDS and not compress:
            # from so many symbols on the code isn't shorter than the data
            code = LZ_BOUNDS[codec](child, parent)
        else:
            code = ENCODERS[codec](child, parent)
    except RawFallback:
        return "simple", child
    code = zstandard.compress(code) if compress else code
    return ("delta", code) if len(code) < len(child) else ("simple", child)


def decode(codec: str, kind: str, payload: bytes, parent: bytes | None, compress: bool = False, permissive: bool = False) -> bytes:
    if kind == "simple":
        return payload
    if parent is None:
        raise KeyError("the parent is missing")
    decoder = PERMISSIVE.get(codec, DECODERS[codec]) if permissive else DECODERS[codec]
    return decoder(parent, zstandard.decompress(payload) if compress else payload)


def instructions(codec: str, kind: str, payload: bytes, compress: bool = False) -> tuple[int, int]:
    """How many copies, matches or edits a code has, and how many bytes it takes from the parent."""
    if kind == "simple":
        return 0, 0
    code, at, n, size = zstandard.decompress(payload) if compress else payload, 0, 0, 0
    if codec == "editscript":
        return len(code) // 4, 0
    if codec in ("lz", "lz_raw"):
        code = unpack_symbols(code) if codec == "lz" else code
        while at < len(code):
            if code[at] == 0:
                at += 2
                continue
            n, size, at = n + 1, size + lz_unflag(code[at], code[at + 1])[0], at + 4
        return n, size
    while at < len(code):
        length = int.from_bytes(code[at : at + 3], "little")
        if length & INSERT:
            at += 3 + length - INSERT
        else:
            n, size, at = n + 1, size + length, at + 6
    return n, size
