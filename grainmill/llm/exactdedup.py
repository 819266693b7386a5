"""Exact duplicates by a tree-merge of sorted digest runs.

Every partition turns its texts into a run of entries (digest, check, smallest id, count)
sorted by digest. Runs then meet in binomial rounds: in a round the tasks whose
numbers differ in one digit of base `fan` exchange parts, each keeping the digests whose own
digit is its number's, and every task merges the parts it got into one sorted run.
After the last round a task holds all entries of its digests. Each merge keeps
one entry a digest, so a text with any number of copies is one entry per task from the
first level on. The sort is Spark's external one and the merge streams over it, so
memory is bounded by a batch.

An entry is verified at every level: beside the SHA-256 it carries the length in bytes
and an independent 64-bit hash of the text, and only entries equal in all three merge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.session import settle

SPACES = r"[\x20\x09-\x0D]+"
ENTRY = ["sha", "n_bytes", "check", "keep_id", "keep_row", "copies"]
SCHEMA = "sha binary, n_bytes int, check long, keep_id long, keep_row long, copies long"


def normalised(text):
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in sorted order -> one entry a digest; the last of a batch waits for the next."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch.select(ENTRY)])
        table = pa.concat_tables([held, table]) if held is not None else table
        # rows are sorted by id within a digest, so the first id is the smallest one
        out = table.group_by(ENTRY[:3], use_threads=False).aggregate([("keep_id", "first"), ("keep_row", "first"), ("copies", "sum")])
        out = out.select([*ENTRY[:3], "keep_id_first", "keep_row_first", "copies_sum"]).rename_columns(ENTRY).cast(table.schema)
        held = out.slice(out.num_rows - 1)
        yield from out.slice(0, out.num_rows - 1).combine_chunks().to_batches()
    if held is not None:
        yield from held.combine_chunks().to_batches()


def merge_runs(runs: DataFrame, fan: int = 8, rounds: int = 2) -> DataFrame:
    """Merge entries in `rounds` rounds among fan ** rounds tasks."""
    tasks = fan**rounds
    order = ["sha", "n_bytes", "check", F.col("keep_id").asc_nulls_last(), "keep_row"]
    #: The task a digest ends in; its digits of base `fan` steer the rounds.
    home = F.pmod(F.xxhash64("sha"), F.lit(tasks)).cast("int")
    out = runs.sortWithinPartitions(*order).mapInArrow(_merge, SCHEMA)
    for r in range(rounds):
        unit = fan**r
        here = F.pmod(F.spark_partition_id(), F.lit(tasks)).cast("int")
        own, at = F.floor(home / unit) % fan, F.floor(here / unit) % fan
        to = (here + (own - at) * unit).cast("int")
        out = out.withColumn("to", to).repartitionById(tasks, F.col("to")).drop("to")
        out = out.sortWithinPartitions(*order).mapInArrow(_merge, SCHEMA)
    return out


def _tree(partitions: int) -> tuple[int, int]:
    """fan and rounds for at least as many tasks as a shuffle of this session has."""
    rounds = 2 if partitions <= 1024 else 3
    return max(2, math.ceil(partitions ** (1 / rounds))), rounds


def exact_duplicates(docs: DataFrame, fan: int | None = None, rounds: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of white space became one
    space; null counts as empty. Of equal texts the row with the smallest doc_id
    stays: of rows that repeat it exactly one, and a row without doc_id only where no
    other has one. Other columns, whatever their names, are left aside.
    An empty table gives an empty one.
    """
    if fan is None or rounds is None:
        fan, rounds = _tree(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = normalised(F.col("text"))
    digests = settle(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        .select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("check"), F.monotonically_increasing_id().alias("row")),
        "digests",
    )
    runs = digests.select("sha", "n_bytes", "check", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("copies"))
    groups = merge_runs(runs, fan, rounds).where("copies > 1")
    out = digests.join(groups, ["sha", "n_bytes", "check"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Which stay is said by `exact_duplicates`; rows are found again by doc_id and digest, so a
    row without doc_id stays where its text has no other. Of rows that repeat both, the smallest
    by all columns stays, which therefore must be sortable.
    """
    found = exact_duplicates(docs).select("doc_id", F.unhex("text_sha256").alias("sha"), "kept")
    kept = settle(found.groupBy("doc_id", "sha").agg(F.max("kept").alias("kept"), F.count("*").alias("times")).where("kept").select("doc_id", "sha", "times"), "kept")
    sha = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), sha.alias("digest"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("digest") == F.col("sha"))
    once = rows.join(kept.where("times = 1"), same, "left_semi").select("row.*")
    often = rows.join(kept.where("times > 1"), same, "left_semi").groupBy("id", "digest").agg(F.min("row").alias("row")).select("row.*")
    return once.unionByName(often)
