"""A put reads the payloads of a store no more often than it needs them, and frees deltas of chunks put anew."""

from pyspark.sql import functions as F

from grainmill.operators import store
from grainmill.session import settle


def test_payload_reads(spark):
    chunks = spark.range(60).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("sha256"), F.expr("cast(concat(repeat('word and word ', 30), id) as binary)").alias("data"), "id")
    first = F.sha2(F.lit("0").cast("binary"), 256)
    members = chunks.select("sha256", F.col("id").alias("sim_hash"), (F.col("id") == 0).alias("is_parent"), first.alias("parent_sha256"), F.lit(0).cast("long").alias("ordinal"))
    kept = settle(store.build_store(chunks.select("sha256", "data"), members), "store")
    assert kept.where("kind = 'delta'").count() == 59
    new = chunks.where("id in (0, 7)").select("sha256", F.lit(b"new").alias("data"))
    got = store.put(kept, new)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sum("ReadSchema" in x and "payload" in x for x in plan.splitlines()) <= 3
    want = {r.sha256: b"new" if r.id in (0, 7) else bytes(r.data) for r in chunks.collect()}
    assert {r.sha256: bytes(r.payload) for r in got.collect()} == want
    assert got.where("kind <> 'simple' or parent_sha256 is not null").count() == 0
