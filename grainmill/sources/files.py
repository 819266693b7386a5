"""Files as rows of bytes, and the store and recipes as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.session import holds_rows


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file_id (the path) and content of all files below `path` whose names fit the pattern; none of more than 2 GB."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select(F.col("path").alias("file_id"), "content")


def write_store(kept: DataFrame, recipes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a store and the recipes of its files below `path`, a file's recipe in one place."""
    kept.write.mode(mode).parquet(f"{path}/store")
    recipes.repartition("file_id").sortWithinPartitions("file_id", "seq").write.mode(mode).parquet(f"{path}/recipes")


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(store, recipes) written there."""
    if not holds_rows(spark, f"{path}/store"):
        raise FileNotFoundError(f"no store at {path}")
    return spark.read.parquet(f"{path}/store"), spark.read.parquet(f"{path}/recipes")
