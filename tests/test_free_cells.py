"""Cells are found in a time that goes with the chunks, however long a run of taken cells is."""

import random
import time

import pytest

from grainmill.operators import store


def probed(hashes, last=store.Cells.LAST):
    """Cell by cell."""
    taken, out = set(), []
    for h in hashes:
        k = 0
        while True:
            free = [x for x in (h + k, h - k) if 0 <= x <= last and x not in taken]
            if free:
                break
            k += 1
        taken.add(free[0])
        out.append(free[0])
    return out


def test_equals_probing():
    rnd = random.Random(3)
    for most in (3, 40, 300, 1 << 20):
        for base in (0, 60_000, store.Cells.LAST - most):
            hashes = [base + rnd.randrange(most + 1) for _ in range(700)]
            assert store.free_cells(hashes) == probed(hashes)


def test_spans_meet():
    edge = 1 << store.Cells.SPAN_BITS
    hashes = [edge - 1, edge + 1, edge, edge, edge + 1, edge - 1, 3 * edge, 3 * edge - 1, 3 * edge]
    assert store.free_cells(hashes) == probed(hashes)


def test_many_of_few_hashes():
    began = time.perf_counter()
    cells = store.free_cells([k * 31 % 97 for k in range(200_000)])
    assert sorted(cells) == list(range(200_000))
    assert time.perf_counter() - began < 20


def test_full():
    cells = store.Cells()
    cells.ends[0], cells.firsts[store.Cells.LAST] = store.Cells.LAST, 0
    cells.spans[0], cells.order = [0], [0]
    with pytest.raises(ValueError):
        cells.take(5)
