"""The chunk store: parents raw, other members of a cluster as delta codes, and the way back.

Children meet their parents in an equi-join that adaptive execution may split, so
a giant cluster is encoded in parallel. Each row says by which codec it was written, and is read by that one.
A file is put together from its sorted chunks in one pass; as one value it must fit into a task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.batches import BATCH_BYTES, map_batches
from grainmill.operators import codecs

STORE = "sha256 string, hash long, kind string, parent_sha256 string, ordinal long, codec string, compressed boolean, raw_length long, payload binary"
EMPTY = hashlib.sha256(b"").hexdigest()


def encode_children(pairs: DataFrame, codec: str, compress: bool = False) -> DataFrame:
    """(id columns ..., kind, payload) for pairs (..., child, parent): the last two columns are binary."""
    keys = pairs.columns[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [codecs.encode(codec, c, p, compress) for c, p in zip(batch.column("child").to_pylist(), batch.column("parent").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.binary())], [*keys, "kind", "payload"])

    schema = pairs.select(*keys).schema.add("kind", "string").add("payload", "binary")
    return map_batches(pairs, run, schema)


def decode_children(pairs: DataFrame, permissive: bool = False) -> DataFrame:
    """(id columns ..., data) for pairs (..., kind, codec, compressed, payload, parent); a null kind gives null."""
    names = ["codec", "kind", "payload", "parent", "compressed"]
    keys = pairs.columns[:-5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in names), strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([None if r[1] is None else codecs.decode(*r, permissive) for r in rows], pa.binary())], [*keys, "data"])

    return map_batches(pairs.select(*keys, *names), run, T.StructType([*pairs.select(*keys).schema.fields, T.StructField("data", T.BinaryType())]))


def code_sizes(coded: DataFrame) -> DataFrame:
    """(id columns ..., kind, payload_bytes, steps, copied_bytes) for codes (..., kind, codec, compressed, payload)."""
    names = ["codec", "kind", "payload", "compressed"]
    keys = coded.columns[:-4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            found = [codecs.instructions(*r) for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("kind"), *(pa.array(x, pa.int64()) for x in ([len(r[2]) for r in rows], [f[0] for f in found], [f[1] for f in found]))], [*keys, "kind", "payload_bytes", "steps", "copied_bytes"])

    more = [T.StructField("kind", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("payload_bytes", "steps", "copied_bytes"))]
    return map_batches(coded.select(*keys, *names), run, T.StructType([*coded.select(*keys).schema.fields, *more]))


def build_store(chunks: DataFrame, members: DataFrame, codec: str = "gearword", compress: bool = False, held: DataFrame | None = None) -> DataFrame:
    """Store rows for unique chunks (sha256, data) with members (sha256, sim_hash, is_parent, parent_sha256, ordinal).

    Parents may also be raw chunks of the store `held`.
    """
    raw = chunks.select("sha256", "data")
    if held is not None:
        raw = raw.unionByName(held.where("kind = 'simple' and parent_sha256 is null").select("sha256", F.col("payload").alias("data")))
    parents = members.where("is_parent").join(chunks, "sha256")
    simple = parents.select("sha256", F.col("sim_hash").alias("hash"), F.lit("simple").alias("kind"), F.lit(None).cast("string").alias("parent_sha256"), F.lit(None).cast("long").alias("ordinal"), F.lit(codec).alias("codec"), F.lit(compress).alias("compressed"), F.octet_length("data").cast("long").alias("raw_length"), F.col("data").alias("payload"))
    children = members.where("not is_parent").join(chunks, "sha256").select("sha256", F.col("sim_hash").alias("hash"), "parent_sha256", "ordinal", F.octet_length("data").cast("long").alias("raw_length"), F.col("data").alias("child"))
    pairs = children.join(raw.select(F.col("sha256").alias("parent_sha256"), F.col("data").alias("parent")), "parent_sha256").select("sha256", "hash", "parent_sha256", "ordinal", "raw_length", "child", "parent")
    delta = encode_children(pairs, codec, compress).select("sha256", "hash", "kind", "parent_sha256", "ordinal", F.lit(codec).alias("codec"), F.lit(compress).alias("compressed"), "raw_length", "payload")
    return simple.unionByName(delta)


def get(store: DataFrame, keys: DataFrame, missing: str = "null", permissive: bool = False) -> DataFrame:
    """(sha256, data) for keys (sha256): raw, or decoded by the row's own codec against the parent; absent keys give null or raise."""
    raw = store.where("kind = 'simple'").select(F.col("sha256").alias("parent_sha256"), F.col("payload").alias("parent"))
    found = keys.join(store.select("sha256", "kind", "codec", "compressed", "parent_sha256", "payload"), "sha256", "left")
    if missing == "raise":
        found = found.withColumn("kind", F.when(F.col("kind").isNull(), F.raise_error(F.concat(F.lit("no such key: "), "sha256"))).otherwise(F.col("kind")))
    plain = F.coalesce(F.col("kind") == "simple", F.lit(True))
    coded = found.where(~plain).join(raw, "parent_sha256", "left").select("sha256", "kind", "codec", "compressed", "payload", "parent")
    return decode_children(coded, permissive).unionByName(found.where(plain).select("sha256", F.col("payload").alias("data")))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STORE)


def clear(store: DataFrame) -> DataFrame:
    """The store without its rows."""
    return store.limit(0)


def put(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The store with rows (sha256, data) stored raw under their keys, in place of what it held there.

    Deltas against a chunk that is put anew are decoded first and stored raw, so they keep their data.
    Of rows that repeat a key the one with the largest data counts.
    """
    new = rows.groupBy("sha256").agg(F.max("data").alias("payload"))
    keys = new.select("sha256")
    stale = store.where("parent_sha256 is not null and kind = 'delta'").join(keys.withColumnRenamed("sha256", "parent_sha256"), "parent_sha256", "left_semi")
    kept = store.join(keys.unionByName(stale.select("sha256")), "sha256", "left_anti").select(*store.columns)
    # only deltas and the chunks put anew that they were made against are looked at again
    parents = store.where("kind = 'simple'").select(F.col("sha256").alias("parent_sha256"), F.col("payload").alias("parent"))
    freed = missing(keys, stale.select("sha256", "hash", "kind", "codec", "compressed", "parent_sha256", "payload")).join(parents, "parent_sha256", "left")
    back = decode_children(freed.select("sha256", "hash", F.col("codec").alias("_codec"), F.col("compressed").alias("_compressed"), "kind", "codec", "compressed", "payload", "parent"))
    back = back.select("sha256", "hash", F.col("_codec").alias("codec"), F.col("_compressed").alias("compressed"), F.col("data").alias("payload"))
    put_ = new.select("sha256", F.lit(None).cast("long").alias("hash"), F.lit(None).cast("string").alias("codec"), F.lit(False).alias("compressed"), "payload").unionByName(back)
    none = F.lit(None)
    raw = put_.select("sha256", "hash", F.lit("simple").alias("kind"), none.cast("string").alias("parent_sha256"), none.cast("long").alias("ordinal"), "codec", "compressed", F.octet_length("payload").cast("long").alias("raw_length"), "payload")
    return kept.unionByName(raw)


def contains(store: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(store.select("sha256"), "sha256", "left_semi")


def missing(store: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(store.select("sha256"), "sha256", "left_anti")


def bare() -> Column:
    """Does a recipe's row stand for a file without bytes, empty or null? No chunk belongs to it."""
    return F.col("sha256").isNull() | (F.col("sha256") == EMPTY)


def restore(recipes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, content) from recipes (file_id, seq, sha256) and chunks (sha256, data); rows of files without bytes need none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, ends, null, data = [], [0], [], bytearray()  # the last file may go on

        def made() -> pa.RecordBatch:
            whole = pa.Array.from_buffers(pa.binary(), len(files), [None, pa.array(ends, pa.int32()).buffers()[1], pa.py_buffer(data)])
            return pa.RecordBatch.from_arrays([pa.array(files, kind), pc.if_else(pa.array(null), None, whole) if any(null) else whole], ["file_id", "content"])

        for batch in batches:
            kind = batch.column(0).type
            for f, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not files or f != files[-1]:
                    if len(data) >= BATCH_BYTES:
                        yield made()
                        files, ends, null, data = [], [0], [], bytearray()
                    files.append(f)
                    ends.append(len(data))
                    null.append(part is None)
                data += part or b""
                ends[-1] = len(data)
        if files:
            yield made()

    nothing = recipes.where(bare()).select("file_id", "seq", F.when(F.col("sha256").isNotNull(), F.lit(b"")).alias("data"))
    rows = recipes.where(~bare()).join(chunks, "sha256").select("file_id", "seq", "data").unionByName(nothing)
    rows = rows.repartition("file_id").sortWithinPartitions("file_id", "seq").select("file_id", "data")
    return map_batches(rows, run, T.StructType([recipes.schema["file_id"], T.StructField("content", T.BinaryType())]))


class Cells:
    """Taken cells as runs without a gap: a run's first and last cell know each other, and first cells are sorted within spans of cells.

    Memory goes with the runs, time with the cells asked for, however long the runs are.
    """

    SPAN_BITS, LAST = 16, 0xFFFFFFFF

    def __init__(self):
        self.ends: dict[int, int] = {}
        self.firsts: dict[int, int] = {}
        self.spans: dict[int, list[int]] = {}
        self.order: list[int] = []

    def _run(self, cell: int) -> tuple[int, int] | None:
        """First and last cell of the run that holds the cell."""
        if cell in self.ends:
            return cell, self.ends[cell]
        span = cell >> self.SPAN_BITS
        firsts = self.spans.get(span, ())
        k = bisect_right(firsts, cell)
        if not k:
            at = bisect_left(self.order, span)
            if not at:
                return None
            firsts = self.spans[self.order[at - 1]]
            k = len(firsts)
        first = firsts[k - 1]
        return (first, self.ends[first]) if self.ends[first] >= cell else None

    def _drop(self, first: int) -> None:
        span = first >> self.SPAN_BITS
        firsts = self.spans[span]
        del firsts[bisect_left(firsts, first)]
        if not firsts:
            del self.spans[span]
            del self.order[bisect_left(self.order, span)]

    def _add(self, first: int) -> None:
        span = first >> self.SPAN_BITS
        if span not in self.spans:
            self.spans[span] = []
            insort(self.order, span)
        insort(self.spans[span], first)

    def take(self, cell: int) -> int:
        """The cell, or the nearest free one, the upper one in a tie; it is taken from now on."""
        run = self._run(cell)
        if run is not None:
            down, up = run[0] - 1, run[1] + 1
            if down < 0 and up > self.LAST:
                raise ValueError("no free cell")
            cell = down if up > self.LAST or (down >= 0 and cell - down < up - cell) else up
        first, last = self.firsts.pop(cell - 1, cell), cell
        if cell + 1 in self.ends:
            last = self.ends.pop(cell + 1)
            self._drop(cell + 1)
        if first == cell:
            self._add(cell)
        self.ends[first], self.firsts[last] = last, first
        return cell


def free_cells(hashes: list[int]) -> list[int]:
    """The cell of each raw chunk: its hash, or the nearest free one, probing h + 1, h - 1, h + 2, ..."""
    cells = Cells()
    return [cells.take(h) for h in hashes]


def place(hashed: DataFrame) -> DataFrame:
    """Adds the cell to rows (arrival, sim_hash), which take theirs in order of arrival.

    Each cell depends on all before it, so one task folds the rows, of two numbers each; it sorts them as Spark does, beyond
    memory on disk, and holds one batch and the runs of taken cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([cells.take(h) for h in batch.column(1).to_pylist()], pa.int64())], ["arrival", "sim_hash", "cell"])

    return hashed.select("arrival", "sim_hash").repartition(1).sortWithinPartitions("arrival").mapInArrow(run, "arrival long, sim_hash long, cell long")
