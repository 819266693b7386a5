"""Bounds on what Python workers hold: a batch may have any amount of text, and Spark keeps workers between tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from grainmill.batches import give_back
from grainmill.llm.words import GROUP_BYTES, document_groups


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of at most GROUP_BYTES of text, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for a, b in document_groups(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])):
        yield batch.slice(a, b - a)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, which gives back free memory after the last batch of a partition."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_group(run: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """`run`, which gives back free memory after each group of more than GROUP_BYTES."""

    @wraps(run)
    def tidied(key: tuple, table: pa.Table) -> pa.Table:
        out = run(key, table)
        if table.nbytes > GROUP_BYTES:
            give_back()
        return out

    return tidied
