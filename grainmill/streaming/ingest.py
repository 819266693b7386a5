"""Incremental ingest: each batch adds its new chunks to a Parquet store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.operators import store
from grainmill.session import holds_rows


def add_batch(path: str, chunk: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends chunks not yet in `path`; a repeated batch adds nothing."""

    def run(files: DataFrame, batch: int) -> None:
        spark = files.sparkSession
        new = chunk(files).groupBy("sha256").agg(F.first("data").alias("data"))
        if holds_rows(spark, path):
            new = store.missing(spark.read.parquet(path), new)
        new.write.mode("append").parquet(path)

    return run
