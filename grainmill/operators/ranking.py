"""Ranks within groups, any of which may be larger than a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.session import settle

#: monotonically_increasing_id has the partition above this many bits.
_PART_BITS = 33


def in_order(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds a number that rises with `order`, with gaps between partitions; to be settled before it is used twice."""
    return rows.repartitionByRange(_partitions(rows), *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the rank from 0 within the group, whose columns hold no null.

    Rows are range-partitioned by group and order, so a hot group spans tasks; one row for each
    group and partition carries the ranks across the borders.
    """
    at = settle(in_order(rows, [*group, *order], "_at"), "ranks").withColumn("_part", F.shiftright("_at", _PART_BITS))
    runs = at.groupBy("_part", *group).agg(F.min("_at").alias("_from"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_part", *group, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_from")).alias("_shift"))
    return at.join(runs, ["_part", *group]).withColumn(name, F.col("_at") + F.col("_shift")).select(*rows.columns, name)


def _partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
