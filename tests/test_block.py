"""The block code's runs are the longest among all places, however often a block repeats."""

import random

from grainmill.operators import codecs

rnd = random.Random(8)


def plain(child: bytes, parent: bytes) -> bytes:
    """Every place tried."""
    out, done, i = [], 0, 0
    while i + 16 <= len(child):
        places = [p for p in range(len(parent) - 15) if parent[p : p + 16] == child[i : i + 16]]
        if not places:
            i += 1
            continue
        size, place = max((codecs._run(child, i, parent, p), -p) for p in places)
        out += [codecs._insert(child[done:i]), codecs._copy(-place, size)]
        done = i = i + size
    return b"".join([*out, codecs._insert(child[done:])])


def test_a_late_long_run():
    parent = b"head" + bytes(100) + rnd.randbytes(50) + bytes(100_000) + b"tail"
    child = b"new" + bytes(90_000) + b"end"
    code = codecs.encode_block(child, parent)
    assert len(code) == len(codecs._insert(b"new") + codecs._insert(b"end")) + 6
    assert codecs.decode_copies(parent, code) == child


def test_equals_all_places():
    for _ in range(60):
        unit = bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 6)))
        runs = [unit * rnd.randrange(1, 60) + bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(4))) for _ in range(9)]
        parent, child = b"".join(runs[:6]), b"".join(rnd.sample(runs, 6))
        code = codecs.encode_block(child, parent)
        assert code == plain(child, parent) and codecs.decode_copies(parent, code) == child


def test_a_parent_is_indexed_in_little_memory():
    """Words are sorted numbers, not an object for each place, and what is held is no more than the last parent's."""
    import tracemalloc

    parent = rnd.randbytes(200_000)
    tracemalloc.start()
    codecs.encode_block(parent[5000:] + parent[:5000], parent)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 1_000_000 and peak < 100 * len(parent)
