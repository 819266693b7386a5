"""Fingerprints of 40-byte shingles that start at every eighth byte, and their overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD, WORDS = 8, 5


def shingles(content: Column) -> Column:
    """The distinct fingerprints of a binary column; a short content has one, an empty one none."""
    size, step = F.octet_length(content), WORD * WORDS
    starts = F.sequence(F.lit(0), F.greatest(size - step, F.lit(0)), F.lit(WORD))
    return F.when(size > 0, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substring(content, i + 1, F.lit(step)))))).otherwise(F.array().cast("array<bigint>"))


def resemblance(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Adds common and united, the sizes of the intersection and union of two shingle columns."""
    return pairs.withColumn("common", F.size(F.array_intersect(left, right)).cast("long")).withColumn("united", F.size(F.array_union(left, right)).cast("long"))
