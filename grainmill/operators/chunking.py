"""Chunks of byte strings: of fixed size, and content-defined by a gear hash."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.batches import BATCH_BYTES, map_batches
from grainmill.functions.gear import rolling

MIN_SIZE, AVG_SIZE, MAX_SIZE = 2 << 10, 8 << 10, 16 << 10
#: Bytes that are hashed at once.
BLOCK = 1 << 20


def fixed_chunks(files: DataFrame, size: int) -> DataFrame:
    """file_id, seq, offset, length, data, sha256 for files (file_id, content); an empty file has no chunk."""
    parts = files.where(F.octet_length("content") > 0).select("file_id", "content", F.posexplode(F.sequence(F.lit(0), F.octet_length("content") - 1, F.lit(size))).alias("seq", "offset"))
    parts = parts.select("file_id", F.col("seq").cast("long").alias("seq"), F.col("offset").cast("long").alias("offset"), F.substring("content", F.col("offset") + 1, F.lit(size)).alias("data"))
    return parts.select("file_id", "seq", "offset", F.octet_length("data").cast("long").alias("length"), "data", F.sha2("data", 256).alias("sha256"))


def gear_cuts(data: bytes, bits: int) -> np.ndarray:
    """Positions before which a rolling hash over the last `bits` bytes has only its top bit set."""
    raw, found = np.frombuffer(data, np.uint8), [np.zeros(0, np.int64)]
    for at in range(0, len(raw), BLOCK):
        ahead = min(at, bits - 1)
        fp = rolling(raw[at - ahead : at + BLOCK], bits)[ahead:] & np.uint64((1 << bits) - 1)
        found.append(np.flatnonzero(fp == np.uint64(1 << bits - 1)) + at)
    return np.concatenate(found)


def bounded_cuts(data: bytes, least: int, mean: int, most: int) -> list[int]:
    """Chunk starts where chunks but the last have `least` to `most` bytes, about `mean`."""
    cuts = gear_cuts(data, max(1, (max(2, mean - least)).bit_length() - 1)).tolist()
    starts, n = [0], len(data)
    while n - starts[-1] > least:
        k = bisect_left(cuts, starts[-1] + least)
        at = min(cuts[k] if k < len(cuts) else n, starts[-1] + most)
        if at >= n:
            break
        starts.append(at)
    return starts


def content_chunks(files: DataFrame, least: int = MIN_SIZE, mean: int = AVG_SIZE, most: int = MAX_SIZE, kind: str = "long", bare: bool = False) -> DataFrame:
    """file_id (of the type `kind`), seq, offset, length, data, sha256 of content-defined chunks.

    A file without bytes has no chunk; bare: it has one row of length 0 all the same, with its content, empty or null, as
    data, so that recipes made of these rows name every file.
    """
    return _cut(files, lambda x: bounded_cuts(x, least, mean, most) if x else [], kind, bare)


def gear_pieces(files: DataFrame, bits: int) -> DataFrame:
    """The same for pieces of no bounded size; a cut before the first byte gives no empty piece."""
    return _cut(files, lambda x: sorted({0, *gear_cuts(x, bits).tolist()}) if x else [])


def _cut(files: DataFrame, starts_of, kind: str = "long", bare: bool = False) -> DataFrame:
    names = ["file_id", "seq", "offset", "length", "data"]

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes | None]]:
        """Row of the file, number of the chunk, offset and data."""
        for i, content in enumerate(batch.column(1)):
            data = memoryview(content.as_buffer()) if content.is_valid else b""
            starts = list(starts_of(data)) if len(data) else []
            for seq, (x, y) in enumerate(zip(starts, [*starts[1:], len(data)], strict=True) if starts else ()):
                yield i, seq, x, bytes(data[x:y])
            if bare and not starts:
                yield i, 0, 0, b"" if content.is_valid else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0

            def made(held: list) -> pa.RecordBatch:
                files, seqs, offsets, data = zip(*held, strict=True)
                numbers = (seqs, offsets, [len(x or b"") for x in data])
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(files, pa.int64())), *(pa.array(x, pa.int64()) for x in numbers), pa.array(data, pa.binary())], names)  # noqa: B023

            for row in rows(batch):
                held.append(row)
                size += len(row[3] or b"")
                if size >= BATCH_BYTES:
                    yield made(held)
                    held, size = [], 0
            if held:
                yield made(held)

    return map_batches(files.select("file_id", "content"), run, f"file_id {kind}, seq long, offset long, length long, data binary").withColumn("sha256", F.sha2("data", 256))


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """sha256, length, copies, first_file, first_seq; payloads stay out of the shuffle."""
    first = F.min(F.struct("file_id", "seq"))
    return chunks.groupBy("sha256", "length").agg(F.count("*").alias("copies"), first.alias("first")).select("sha256", "length", "copies", F.col("first.file_id").alias("first_file"), F.col("first.seq").alias("first_seq"))
