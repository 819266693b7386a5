"""The LZ code takes the match that trying every place gives, and compares few of them."""

import random

import pytest

from grainmill.operators import codecs

rnd = random.Random(11)


def plain(child: bytes, parent: bytes) -> bytes:
    """Every place tried."""
    index, own = {}, {}
    for p in range(len(parent) - 2):
        index.setdefault(parent[p : p + 3], []).append(p)
    out, i, main, aux, last, seen = bytearray(), 0, 0, 0, None, 0
    while i < len(child):
        best = None
        for p in index.get(child[i : i + 3], ())[: codecs.LZ_CHAIN]:
            off, used_main = min(abs(p - main), abs(p - aux)), abs(p - main) <= abs(p - aux)
            size = min(codecs._run(child, i, parent, p), codecs.LZ_MOST)
            score = (size - (off > codecs.LZ_FAR)) << 16 | 0xFFFF - off
            if off <= 0xFFFF and (best is None or score > best[0]):
                best = score, size, off, used_main, p
        p = own.get(child[i : i + 3])
        if p is not None and i - p <= 0xFFFF:
            size = min(codecs._run(child, i, child, p), i - p, codecs.LZ_MOST)
            score = (size - (i - p > codecs.LZ_FAR)) << 16 | 0xFFFF - (i - p)
            if size >= codecs.LZ_LEAST and (best is None or score > best[0]):
                best = score, size, i - p, None, p
        if best is None or best[1] < codecs.LZ_LEAST:
            out += bytes((0, child[i]))
            i += 1
        else:
            _, size, off, used_main, p = best
            kind = codecs.LOCAL if used_main is None else (codecs.MAIN_AFTER if used_main else codecs.AUX_AFTER) + (p < (main if used_main else aux))
            flag, rest = codecs.lz_flag(size, kind)
            out += bytes((flag, rest, off >> 8, off & 255))
            if kind != codecs.LOCAL:
                far = off >= codecs.LZ_NEAR or (last is not None and last >= codecs.LZ_NEAR)
                main, aux = codecs._moved(main, aux, p + size, used_main, far, last is None)
                last = off
            i += size
        while seen + 3 <= i:
            own[child[seen : seen + 3]] = seen
            seen += 1
    return bytes(out)


def near(parent: bytes) -> bytes:
    n = len(parent)
    return parent[n - n // 10 :] + parent[: n // 4] + b"+" + parent[n // 4 : n // 2] + b"#" + parent[n // 2 + 1 :]


def test_equals_all_places():
    for alphabet in (b"ab", b"\0", b"\0ab", b"abcdefgh ", bytes(range(256))):
        for size in (0, 2, 3, 7, 60, 700, 6000):
            parent = bytes(rnd.choice(alphabet) for _ in range(size))
            for child in (near(parent), bytes(rnd.choice(alphabet) for _ in range(min(size, 900))), parent[size // 3 :] + b"\0\0"):
                code = plain(child, parent)
                assert codecs.lz_symbols(child, parent) == code
                assert codecs.unpack_symbols(codecs.pack_symbols(code)) == code
                assert codecs.encode("lz_raw", child, parent) == (("delta", code) if len(code) < len(child) else ("simple", child))


def test_far_places():
    """Beyond 64 KiB from the pointers, and more places of three bytes than are tried."""
    parent = bytes(rnd.choice(b"abcd") for _ in range(90_000))
    child = parent[80_000:80_300] + near(parent[:2000]) + parent[70_000:70_100]
    assert codecs.lz_symbols(child, parent) == plain(child, parent)


def test_few_places_are_compared(monkeypatch):
    """A text of words that recur everywhere: the sizes of matches are known without comparing each place."""
    words = [bytes(rnd.choice(b"abcdefghijkl") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    parent, child = (b" ".join(rnd.choice(words) for _ in range(3000)) for _ in range(2))
    runs, run = [], codecs._run
    monkeypatch.setattr(codecs, "_run", lambda *x: runs.append(1) or run(*x))
    kind, code = codecs.encode("lz_raw", child, parent)
    assert kind == "delta" and codecs.decode("lz_raw", kind, code, parent) == child
    assert len(runs) < len(code) // 2


def _declines(monkeypatch, codec):
    """A text with next to nothing in common with its parent is given up when its code can't be shorter any more, not at its end."""
    child, parent = (bytes(rnd.choice(range(256)) for _ in range(20_000)) for _ in range(2))
    taken, symbols = [], codecs.lz_symbols

    def counted(c, p, most=None):
        try:
            return symbols(c, p, most)
        except codecs.RawFallback:
            taken.append(most)
            raise

    monkeypatch.setattr(codecs, "lz_symbols", counted)
    assert codecs.encode(codec, child, parent) == ("simple", child)
    assert taken and taken[0] < len(symbols(child, parent))
    with pytest.raises(codecs.RawFallback):
        symbols(child, parent, 100)


def test_packed_code_declines(monkeypatch):
    _declines(monkeypatch, "lz")


def test_plain_code_declines(monkeypatch):
    _declines(monkeypatch, "lz_raw")
