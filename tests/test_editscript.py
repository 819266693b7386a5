"""Edit scripts of pairs of any size: the shortest ones, wherever they are worth it."""

import random

import pytest
from test_edit_queries import distance

from grainmill.operators import codecs

rnd = random.Random(3)


@pytest.mark.parametrize("size", [4096, 16384, 60_000])
def test_first_and_last_byte(size):
    parent = rnd.randbytes(size)
    child = bytes([parent[0] ^ 1]) + parent[1:-1] + bytes([parent[-1] ^ 1])
    kind, code = codecs.encode("editscript", child, parent)
    assert (kind, len(code)) == ("delta", 8) and codecs.decode_editscript(parent, code) == child


def test_many_edits_of_a_chunk():
    parent = rnd.randbytes(16384)
    child = bytearray(parent)
    for _ in range(1500):
        at = rnd.randrange(len(child))
        rnd.choice([lambda: child.insert(at, 7), lambda: child.pop(at), lambda: child.__setitem__(at, child[at] ^ 9)])()  # noqa: B023
    kind, code = codecs.encode("editscript", bytes(child), parent)
    assert kind == "delta" and len(code) <= 6000 and codecs.decode_editscript(parent, code) == bytes(child)


def test_scripts_are_shortest():
    for _ in range(400):
        a, b = (bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(90))) for _ in range(2))
        kind, code = codecs.encode("editscript", b, a)
        d = distance(a, b)
        assert (kind == "delta") == (4 * d + 4 <= max(len(b), 4))
        if kind == "delta":
            assert len(code) == 4 * d and codecs.decode_editscript(a, code) == b


def test_unlike_pairs_stay_raw():
    assert codecs.encode("editscript", rnd.randbytes(16384), rnd.randbytes(16384))[0] == "simple"


def test_few_edits_of_a_large_text():
    """The time goes with the edits, and the script is the one that the whole matrix gives."""
    import math
    import random
    import time

    rnd = random.Random(4)
    for size in (4, 17, 60, 400, 3000):
        for _ in range(40):
            parent = bytes(rnd.choice(b"ab") for _ in range(size))
            child = bytearray(parent)
            for _ in range(rnd.randrange(1, 9)):
                at = rnd.randrange(len(child) + 1)
                child[at : at + rnd.randrange(2)] = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(2)))
            child = bytes(child)
            reached = codecs._furthest(parent, child, math.inf)
            edits, i, j = codecs._few_edits(parent, child, reached)
            many, k, m = codecs._many_edits(parent, child, 1 << 30, 0)
            assert [a << 30 | b << 22 | at for a, b, at in edits] == many and (i, j) == (k, m) and len(edits) + i + j == len(reached) - 1
    large = rnd.randbytes(400_000)
    began = time.perf_counter()
    assert len(codecs.encode_editscript(b"\x01" + large[1:200_000] + large[200_001:] + b"\x02", large)) <= 12
    assert time.perf_counter() - began < 3
