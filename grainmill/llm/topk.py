"""Exact top-k by inner product with pivot-table elimination.

Vectors are quantised to floor(256 x). With |q - x|^2 = |q|^2 + |x|^2 - 2 qx, a lower bound
of the distance is an upper bound of the score; by the triangle inequality every pivot
p gives one, |d(q, p) - d(x, p)|, and the largest of them counts. The table of these distances is
computed once, beside the vectors, which lie in order of their nearest pivot and the distance to it,
so that a block of rows is near the same pivots: the ranges of its distances bound all of its scores
at once. Blocks, and then a block's rows, whose bound is below a query's k-th score so far are passed over;
the others are evaluated in order of their bounds until none can enter. The k-th score starts
from those against a sample of rows. So the result is exact.

Queries go out in blocks of bounded size in bytes; each block is one pass over the table, in which
every task returns its best k for each query, and its result is written before the next begins, so
plan and driver stay small however many blocks there are.

Scores are whole numbers of any size: doubles where they hold every sum exactly, Python's integers else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.session import settle, shared_path

PIVOTS, SAMPLE, QUERY_BLOCK, ROW_BLOCK = 32, 2048, 4096, 2048
#: Bytes of one block of queries, as doubles.
QUERY_BYTES = 32 << 20
_LONG = (1 << 63) - 1
_HIT = "row long, query_id long, vec_id long, score string, ordered binary, candidate long"


def _padded(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of doubles, shorter ones with zeros behind."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(size) and (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(size), dims))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def quantise(x: np.ndarray) -> np.ndarray:
    """floor(256 x), as whole doubles; infinite where a double can't hold 256 x."""
    with np.errstate(over="ignore"):
        return np.floor(256.0 * x)


def _whole(x: np.ndarray) -> list[int]:
    """floor(256 x) of one row as integers of any size."""
    return [math.floor(256.0 * v) if abs(v) < 2.0**40 else 256 * int(v) for v in x.tolist()]


def _tops(q: np.ndarray) -> np.ndarray:
    """Each row's largest component, without its sign, times the square root of the number of them."""
    return np.abs(q).max(axis=1, initial=0) * math.sqrt(max(1, q.shape[1]))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
        return np.sqrt(np.maximum(square, 0.0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: farthest-first from the first row."""
    if not len(sample):
        return np.zeros(0, np.int64)
    picked = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(picked) < min(count, len(sample)):
        picked.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[picked[-1:]])[:, 0])
    return np.array(picked)


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the vectors as they are, of the rows that take part.

    Vectors that are null or hold null or non-finite components take none. An empty one does: its scores are 0.
    Shorter vectors count as padded with zeros.
    """
    fit = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.col("embedding").isNotNull() & fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x"))


def pivot_table(rows: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    """Adds near, the number of the nearest pivot, and there, the distances to all of them, to (vec_id, x).

    Distances are floats; one that floats can't hold is not a number, which bounds nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = _distances(quantise(_padded(batch.column(1), dims)), pivots)
            there[~(there < 1e38)] = np.nan
            near = np.nan_to_num(there, nan=np.inf).argmin(axis=1) if len(pivots) else np.zeros(len(there), np.int64)
            offsets = pa.array(np.arange(len(there) + 1) * len(pivots), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(there.ravel().astype(np.float32)))], ["vec_id", "x", "near", "there"])

    schema = T.StructType([*rows.schema.fields, T.StructField("near", T.IntegerType()), T.StructField("there", T.ArrayType(T.FloatType()))])
    return rows.mapInArrow(run, schema)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, found: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id divides by `every`.

    Every row but the query's own is a candidate, also one that repeats its vec_id or has none. Ties go to the
    smaller vec_id, rows without one last. Query rows that repeat a vec_id each have
    their own ranks. Fewer than k candidates give fewer rows, an empty table none. A score
    beyond 64 bits is ranked as it is and given as the nearest long. found: a list that gets a pair for each
    block of queries: how many scores were computed, and how many candidates there were.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = taking_part(vectors)
    dims = rows.agg(F.max(F.size("x"))).first()[0]
    if dims is None:
        return empty
    sample = rows.orderBy(F.xxhash64("vec_id", "x")).limit(SAMPLE).collect()
    near = np.array([[*r["x"], *[0.0] * (dims - len(r["x"]))] for r in sample]).reshape(len(sample), dims)
    fit = np.flatnonzero(np.abs(near).max(axis=1, initial=0) < 1e100)
    pivots = quantise(near[fit])[choose_pivots(quantise(near[fit]), PIVOTS)] if len(fit) else np.zeros((0, dims))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["near", F.get("there", F.col("near")), "vec_id"]
    table = pivot_table(rows, pivots, dims).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # `row` tells rows apart that repeat a vec_id or have none
    table = settle(table.withColumn("row", F.monotonically_increasing_id()), "pivot-table")
    asked = settle(table.where(F.pmod("vec_id", F.lit(every)) == 0).select("row", "vec_id", "x"), "queries")
    # blocks are ranges of rows between rough quantiles, so each holds at most 1.5 times its share
    total = asked.count()
    blocks = max(1, -(-total // max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * max(1, dims))))))
    cuts = [None, *(asked.approxQuantile("row", [i / blocks for i in range(1, blocks)], 0.25 / blocks) if blocks > 1 else []), None]
    path = shared_path(spark, "top")
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = asked.where((F.lit(True) if lo is None else F.col("row") > int(lo)) & (F.lit(True) if hi is None else F.col("row") <= int(hi))).orderBy("row").collect()
        if part:
            block = _Block(part, pivots, dims, k, [r["vec_id"] for r in sample], near)
            done = settle(table.mapInArrow(block.run, _HIT), "hits")
            if found is not None:
                found.append((done.where("candidate is not null").agg(F.sum("candidate")).first()[0], len(part) * table.count()))
            _ranked(done.where("candidate is null"), k).write.mode("append").parquet(path)
    return spark.read.schema(empty.schema).parquet(path) if total else empty


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("ordered"), F.col("vec_id").asc_nulls_last()))
    return hits.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def _ordered(score: int) -> bytes:
    """Bytes that sort as the scores do: sign and length of the number, then the number."""
    size = (abs(score).bit_length() + 7) // 8
    body = abs(score).to_bytes(size, "big")
    head = (0x8000 + size if score >= 0 else 0x7FFF - size).to_bytes(2, "big")
    return head + (body if score >= 0 else bytes(255 - b for b in body))


class _Block:
    """One block of queries, and its search through a task's rows."""

    def __init__(self, part: list, pivots: np.ndarray, dims: int, k: int, sample_ids: list, sample: np.ndarray):
        self.row, self.ids = np.array([r["row"] for r in part], np.int64), np.array([r["vec_id"] for r in part], np.int64)
        self.x = np.array([[*r["x"], *[0.0] * (dims - len(r["x"]))] for r in part]).reshape(len(part), dims)
        self.pivots, self.dims, self.k = pivots, dims, k
        self.floor = self._floors(np.array([-1 if v is None else v for v in sample_ids], np.int64), sample)

    def _floors(self, ids: np.ndarray, sample: np.ndarray) -> np.ndarray:
        """For each query the k-th best score against the sample's rows of other ids: no smaller one can be in the result."""
        q, s = quantise(self.x), quantise(sample)
        out = np.full(len(q), -np.inf)
        for a in range(0, len(q), 512) if len(s) >= self.k else ():
            with np.errstate(all="ignore"):
                scores = q[a : a + 512] @ s.T
                scores[(ids[None, :] == self.ids[a : a + 512, None]) | ~(_tops(q[a : a + 512])[:, None] * _tops(s)[None, :] < 2.0**53)] = -np.inf
            out[a : a + 512] = np.partition(scores, -self.k, axis=1)[:, -self.k]
        return out

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = quantise(self.x)
        tops = _tops(q)
        with np.errstate(all="ignore"):
            square, by_pivot = (q * q).sum(1), _distances(q, self.pivots)
            far = float((self.pivots * self.pivots).sum(1).max(initial=0))
        floor = self.floor.copy()
        best: list[list[tuple[int, int]]] = [[] for _ in self.ids]
        computed = 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                rows = batch.slice(at, ROW_BLOCK)
                x, own = _padded(rows.column("x"), self.dims), rows.column("row").to_numpy()
                ids = [_LONG if v is None else v for v in rows.column("vec_id").to_pylist()]
                c, there = quantise(x), _padded(rows.column("there"), len(self.pivots))
                wide = _tops(c)
                with np.errstate(all="ignore"):
                    size = (c * c).sum(1)
                    # the ranges of the block's distances bound all of its scores
                    low = np.zeros(len(q))
                    if len(self.pivots):
                        low = np.maximum(by_pivot - there.max(axis=0), there.min(axis=0) - by_pivot).max(axis=1)
                    open_ = np.flatnonzero(~(self._high(low, square, size.max(), far) < floor))
                for a in range(0, len(open_), 64):
                    some = open_[a : a + 64]
                    with np.errstate(all="ignore"):
                        low = np.zeros((len(some), len(x)))
                        for p in range(len(self.pivots)):
                            np.maximum(low, np.abs(by_pivot[some, p][:, None] - there[None, :, p]), out=low)
                        high = self._high(low, square[some][:, None], size[None, :], far)
                    high[np.isnan(high)] = np.inf
                    for n, i in enumerate(some):
                        computed += self._evaluate(int(i), high[n], x, c, q, own, ids, wide * tops[i], best, floor)
        out = [(int(self.row[i]), int(self.ids[i]), None if v == _LONG else v, str(max(-_LONG - 1, min(_LONG, s))), _ordered(s), None) for i, found in enumerate(best) for s, v in found]
        out.append((None, None, None, None, None, computed))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["row", "query_id", "vec_id", "score", "ordered", "candidate"])

    @staticmethod
    def _high(low, one, other, far: float):
        """The score's upper bound where the distance is at least `low`; rounding never makes it too tight."""
        both = one + other
        low = np.maximum(low - 1e-6 * np.sqrt(both + far), 0)
        return (both * (1 + 1e-9) - low * low) / 2 + 0.5

    def _evaluate(self, i: int, high: np.ndarray, x: np.ndarray, c: np.ndarray, q: np.ndarray, own: np.ndarray, ids: list, wide: np.ndarray, best: list, floor: np.ndarray) -> int:
        """Candidates of query i in order of their bounds, in steps that double, until none can enter."""
        todo = np.flatnonzero((high >= floor[i]) & (own != self.row[i]))
        todo = todo[np.argsort(-high[todo], kind="stable")]
        at, step, done = 0, 256, 0
        while at < len(todo) and high[todo[at]] >= floor[i]:
            here = todo[at : at + step]
            held = wide[here] < 2.0**53  # doubles hold every partial sum
            scores = c[here] @ q[i] if held.all() else np.where(held, np.where(held[:, None], c[here], 0) @ np.where(abs(q[i]) < 1e300, q[i], 0), -np.inf)
            new = [(int(scores[j]), ids[here[j]]) for j in np.flatnonzero(scores >= floor[i]) if held[j]]
            if not held.all():
                mine = _whole(self.x[i])
                new += [(sum(a * b for a, b in zip(_whole(x[j]), mine, strict=True)), ids[j]) for j in here[~held]]
            if new:
                best[i] = sorted([*best[i], *new], key=lambda e: (-e[0], e[1]))[: self.k]
                if len(best[i]) == self.k:
                    # a score that a double can't hold is rounded towards the candidates
                    floor[i] = max(floor[i], _below(best[i][-1][0]))
            done, at, step = done + len(here), at + step, step * 2
        return done


def _below(score: int) -> float:
    """The largest double that isn't above a whole number."""
    try:
        near = float(score)
    except OverflowError:
        return np.finfo(float).max if score > 0 else -np.inf
    return near if near <= score else float(np.nextafter(near, -np.inf))
