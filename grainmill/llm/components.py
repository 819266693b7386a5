"""Connected components of an edge table by alternating large and small stars.

Every step is a grouped minimum with map-side combining and an equi-join that
adaptive execution may split where a node is hot; each round is written to the
shared folder. No edge, component or label ever reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.session import drop_settled, settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (a, b) with a > b; returns edges of the same form."""
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        pairs = pairs.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    #: Settled, so that the join has exchanges of its own, which can be split at a hot node.
    least = settle(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    met = pairs.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long) that isn't its own root.

    The root is the smallest node of the component. Loops, repeated edges and
    both directions are allowed; an empty table gives an empty one.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    while True:
        nxt = settle(_star(_star(now, True), False), "edges")
        drop_settled(now)
        now = nxt
        new = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if new == sign:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        sign = new
