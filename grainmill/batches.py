"""Bounds on what Python workers hold: batches by bytes as well as by rows, and freed memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Bytes of a batch, which may be one row more, and Spark's own setting, in whose place it comes.
BATCH_BYTES, _SETTING, _DEFAULT = 1 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def give_back() -> None:
    """Return what is free in this process to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """mapInArrow over batches of at most BATCH_BYTES and a row, unless the session has a bound of its own."""
    conf = rows.sparkSession.conf
    if conf.get(_SETTING, _DEFAULT) == _DEFAULT:
        conf.set(_SETTING, f"{BATCH_BYTES}b")

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows.mapInArrow(tidied, schema)
