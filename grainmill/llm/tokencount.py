"""Token counts by scanning flat token files for separators.

A token file is nothing but little-endian 16-bit ids, document after document, each
followed by the end-of-document id; there is no index. Files are searched in blocks of
fixed size that start anywhere in a document. Within a block numpy finds all separators at
once. What lies across block borders is stitched by a prefix scan over one row per block:
a running maximum gives the last separator before a block, a running sum the number
of documents that ended before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.llm.bpe import tokenizer_of
from grainmill.session import forget, settle, shared_path

SEPARATOR = 49407
BLOCK_BYTES = 4 << 20


def write_token_files(docs: DataFrame, tokenizer_path: str, at: str, separator: int = SEPARATOR) -> DataFrame:
    """Write a token file per task below `at`; (file, ordinal, doc_id) says whose tokens come where.

    The separator's string in a text is ordinary text. A file of a lost or repeated
    task isn't named in the result, so nothing reads it.
    """
    with open(tokenizer_path, "rb") as f:
        spec = f.read()
    if max(len(tokenizer_of(spec, special=False).labels) - 1, separator) >= 1 << 16:
        raise ValueError("this vocabulary has ids beyond 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(spec, special=False)
        store, root = fs.FileSystem.from_uri(at)
        store.create_dir(root, recursive=True)
        name, ordinal, out = f"{uuid.uuid4().hex}.bin", 0, None
        end = np.array([separator], "<u2").tobytes()
        try:
            for batch in batches:
                out = out or store.open_output_stream(f"{root}/{name}")
                for text in batch.column(1).to_pylist():
                    for ids in tok.encode_pieces(text or ""):
                        out.write(np.frombuffer(ids, "<u4").astype("<u2").tobytes())
                    out.write(end)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column(0)], ["file", "ordinal", "doc_id"])
                ordinal += n
        finally:
            if out is not None:
                out.close()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "file string, ordinal long, doc_id long")
    return settle(rows, "token-documents")


def scan_token_files(spark: SparkSession, at: str, files: DataFrame, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal, n_tokens of each document in the token files named in `files` (file)."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(at)
        for batch in batches:
            names = batch.column(0).to_pylist()
            size = [store.get_file_info(f"{root}/{x}").size for x in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64())], ["file", "size"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(at)
        for batch in batches:
            for name, block, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes), "<u2")
                ends = np.flatnonzero(ids == separator) + block * (block_bytes // 2)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([block], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))], ["file", "block", "ends"])

    blocks = files.mapInArrow(sizes, "file string, size long").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("size") / block_bytes) - 1).cast("long"))).alias("block"), "size")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = settle(blocks.repartition(tasks, "file", "block").mapInArrow(search, "file string, block long, ends array<long>"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select("file", "block", F.size("ends").alias("n"), F.array_max("ends").alias("last"))
    stitched = stitched.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("done"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"))
    ends = found.join(stitched, ["file", "block"])
    ends = ends.select("file", "done", F.posexplode(F.arrays_zip("ends", F.concat(F.array("previous"), "ends").alias("starts"))))
    out = ends.where("col.ends is not null").select("file", (F.col("done") + F.col("pos")).alias("ordinal"), (F.col("col.ends") - F.col("col.starts") - 1).alias("n_tokens"))
    return out


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens of every document, counted in token files written for the purpose.

    Null counts as empty: 0 tokens. Rows that repeat each give a row, null doc_ids stay, other
    columns are left aside, and an empty table gives an empty one. The files are
    removed once they are counted.
    """
    spark = docs.sparkSession
    at = shared_path(spark, "tokens")
    owners = write_token_files(docs, tokenizer_path, at)
    counts = settle(scan_token_files(spark, at, owners.select("file").distinct()), "token-counts")
    forget(spark, at)
    return owners.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
