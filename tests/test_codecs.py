import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grainmill.operators import codecs

rnd = random.Random(5)
PARENT = rnd.randbytes(8192)
PERIODIC = bytes(i % 256 for i in range(9108))


def edited(data, *at):
    out = bytearray(data)
    for i in at:
        out[i] ^= 0x5A
    return bytes(out)


CASES = {
    "same": (PARENT, PARENT),
    "empty child": (b"", PARENT),
    "empty parent": (PARENT[:100], b""),
    "tiny": (bytes([1, 2, 3, 4, 6]), bytes([1, 2, 3, 4, 5])),
    "one edit": (edited(PARENT, 15), PARENT),
    "two adjacent": (edited(PARENT, 15, 16), PARENT),
    "two distant": (edited(PARENT, 15, 106), PARENT),
    "cut left": (PARENT[15:], PARENT),
    "cut right": (PARENT[:8000], PARENT),
    "cut both": (edited(PARENT, 40, 90)[15:8000], PARENT),
    "shift right": (PARENT + PARENT[8000:], PARENT),
    "shift left": (PARENT[:192] + PARENT, PARENT),
    "periodic": (edited(PERIODIC, 100, 3000), PERIODIC),
    "rotated": (PERIODIC[500:] + PERIODIC[:500], PERIODIC),
    "constant": (b"a" * 3000, b"a" * 5000),
    "long": (rnd.randbytes(3000) + PARENT * 5 + b"x", PARENT * 6),
}


@pytest.mark.parametrize("codec", codecs.ENCODERS)
@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("compress", [False, True])
def test_round_trip(codec, case, compress):
    child, parent = CASES[case]
    kind, code = codecs.encode(codec, child, parent, compress)
    assert codecs.decode(codec, kind, code, parent, compress) == child


@pytest.mark.parametrize("codec", codecs.ENCODERS)
@given(st.binary(max_size=300), st.lists(st.tuples(st.integers(0, 299), st.binary(max_size=20)), max_size=4))
@settings(max_examples=60, deadline=None)
def test_edits_round_trip(codec, parent, edits):
    child = parent
    for at, new in edits:
        child = child[:at] + new + child[at + 1 :]
    kind, code = codecs.encode(codec, child, parent)
    assert codecs.decode(codec, kind, code, parent) == child


def test_edit_is_short():
    assert len(codecs.encode_gearword(edited(PARENT, 4000), PARENT)) < 50
    assert len(codecs.encode_editscript(edited(PARENT, 4000), PARENT)) == 4


def test_flags_are_inverse():
    for size in range(3, 1027):
        for kind in range(5):
            assert codecs.lz_unflag(*codecs.lz_flag(size, kind)) == (size, kind)
    for size in (2, 1027):
        with pytest.raises(ValueError):
            codecs.lz_flag(size, 0)


@pytest.mark.parametrize("code", [b"\x05\x00\x00\xff\xff\xff", b"\x05\x00\x00\x01\x00\x00"])
def test_copy_outside_the_parent(code):
    with pytest.raises(ValueError):
        codecs.decode_copies(b"abc", code)


def test_malformed_lz():
    with pytest.raises(ValueError):
        codecs.lz_restore(b"abc", bytes([21, 0, 0, 0]))
    with pytest.raises(ValueError):
        codecs.lz_restore(b"abc", bytes([2, 9, 0, 0]))


def test_prefix_code_lengths():
    _, size = codecs.prefix_code()
    assert sum(2.0**-n for n in size) == 1.0
    assert max(size[:128]) <= 8 < min(size[128:]) + 1
