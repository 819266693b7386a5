"""Spark session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int | None = None) -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("grainmill")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GRAINMILL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only in local mode (tests on one machine) a temporary folder may take its place;
    a cluster without the setting is an error, as its executors would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="grainmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/grainmill/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget_quietly, spark, path)
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a path of any Hadoop file system."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def holds_rows(spark: SparkSession, path: str) -> bool:
    """Is there a folder with Parquet files at the path?"""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*.parquet")
    found = files.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(files)
    return found is not None and len(found) > 0


def _forget_quietly(spark: SparkSession, path: str) -> None:
    try:
        forget(spark, path)
    except Exception:  # the JVM has gone first
        if path.startswith("file:"):
            import shutil

            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation,
    and every reader sees the same rows. The path is `df.settled_at`.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def drop_settled(*tables: DataFrame) -> None:
    """Remove settled tables that nothing reads any more."""
    for df in tables:
        forget(df.sparkSession, df.settled_at)
