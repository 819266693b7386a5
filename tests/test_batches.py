"""Python workers take tables by bytes, not by rows alone."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainmill.batches import BATCH_BYTES
from grainmill.operators import chunking, codecs, store

SIZE = 3000


@pytest.fixture
def rows(spark):
    return spark.range(4000).select(F.col("id").alias("item_id"), F.expr(f"cast(repeat('x', {SIZE}) as binary)").alias("child"), F.expr(f"cast(repeat('y', {SIZE}) as binary)").alias("parent")).coalesce(1)


@pytest.mark.parametrize("codec", ["gearword", "editscript"])
def test_codes_of_a_batch(rows, codec):
    """What goes through an encoder, here as the data itself, and comes out again is in batches of about BATCH_BYTES."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    coded = store.encode_children(rows, codec)
    sizes = [r.n for r in coded.mapInArrow(run, "n long").collect()]
    assert sum(sizes) == 4000 and max(sizes) * SIZE <= BATCH_BYTES + 2 * SIZE


def test_found_rows(spark, rows):
    """The same for keys that are looked up in a store."""
    kept = rows.select(F.sha2(F.concat("child", F.col("item_id").cast("string").cast("binary")), 256).alias("sha256"), F.lit(1).cast("long").alias("hash"), F.lit("simple").alias("kind"), F.lit(None).cast("string").alias("parent_sha256"), F.lit(None).cast("long").alias("ordinal"), F.lit("gearword").alias("codec"), F.lit(False).alias("compressed"), F.lit(SIZE).cast("long").alias("raw_length"), F.col("child").alias("payload"))
    found = store.get(kept, kept.select("sha256"))
    assert found.count() == 4000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == BATCH_BYTES


def test_cuts_of_a_large_file():
    """The hash of a file is taken by blocks, whatever its size, with the same cuts."""
    data = random.Random(2).randbytes(5 * chunking.BLOCK + 77)
    whole = [int(x) for x in chunking.np.flatnonzero((chunking.rolling(chunking.np.frombuffer(data, chunking.np.uint8), 13) & chunking.np.uint64(8191)) == chunking.np.uint64(4096))]
    tracemalloc.start()
    cuts = chunking.gear_cuts(data, 13)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert cuts.tolist() == whole and len(whole) > 100
    assert peak < 8 * len(data)


def test_words_of_one_parent_are_held():
    codecs._word_index.cache_clear()
    for k in range(4):
        codecs.encode_gearword(bytes(100), bytes([k]) * 5000)
    assert codecs._word_index.cache_info().currsize == 1
