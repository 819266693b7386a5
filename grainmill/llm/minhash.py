"""Near-duplicate documents by min-max hashing, with links confirmed on full shingle sets.

Each permutation gives two signature values, its minimum and its maximum over the
document's shingles, so 128 values cost 64 hash evaluations a shingle. Both estimate the
Jaccard similarity without bias, and the mean over both has the lower variance.
Bands of four minima, and bands of four maxima, of the same permutations find
candidates: two sets with similarity 0.75 miss all 32 bands with probability 5e-6, more
similar ones less often. Every link is confirmed on full sets, so none is false.

Steps, none of which emits all pairs of a group or collects one:

1. Rows are written once with numbers of their own, so nothing depends on doc_ids being there or distinct. One
   Arrow pass gives each row its set size, a 128-bit digest of its set and its signature.
   Rows with equal sets become one node, which has the smallest row number of them, so exact copies cost
   nothing further.
2. Buckets of a band are stars: every member is checked against the smallest one.
   Confirmed stars are joined into components.
3. Buckets that still hold several components are searched in blocks of bounded size:
   pairs from different components whose signatures agree in 72 of the 128 values are
   checked on their full sets within the task, and only links that join components leave
   it. A pair at 0.75 agrees in fewer with probability 1e-6. What is emitted stays in
   proportion to the members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.components import components
from grainmill.llm.words import U64, common, mix, shingle_sets
from grainmill.llm.worker import tidy, tidy_group
from grainmill.session import drop_settled, settle

PERMUTATIONS, ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Members of a bucket that meet in one task.
BLOCK = 2048
BLOCK_SHINGLES = 1 << 21
#: Signature values that must agree before a pair of step 3 is checked exactly: 4.9
#: standard deviations under 0.75 of them all.
AGREE = 72
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of 64 minima and then 64 maxima (uint32), for sets that aren't empty."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    x = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint32)
    y = np.empty_like(x)
    for k in range(PERMUTATIONS):
        np.multiply(x, _A[k], out=y)
        y += _B[k]
        out[:, k] = np.minimum.reduceat(y, starts)
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(y, starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row: bands of minima, then bands of maxima."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(U64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9FB21C651E98DF25), parts.shape[:2])
    for k in range(ROWS):
        key = mix(key * U64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return key.view(np.int64)


@tidy
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column(0)
        for first, sets in shingle_sets(batch.column(1)):
            sizes = np.array([len(s) for s in sets], np.int64)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            full = [s for s in sets if len(s)]
            sigs = iter(signatures(full)) if full else iter(())
            sig = [next(sigs).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([rows.slice(first, len(sets)), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(sig, pa.binary())], ["row", "n_shingles", "digest", "sig"])


def _rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), 2 * PERMUTATIONS)


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            keys = band_keys(_rows_of(part.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], ["bucket", "node"])


def _confirm(percent: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sides = []
            for ids, texts in ((a, batch.column(2)), (b, batch.column(3))):
                own = {x: i for i, x in reversed(list(enumerate(ids)))}
                found: dict[int, np.ndarray] = {}
                order = list(own)
                for first, sets in shingle_sets(texts.take(pa.array([own[x] for x in order], pa.int64()))):
                    for x, s in zip(order[first : first + len(sets)], sets, strict=True):
                        found[x] = s
                sides.append(found)
            keep = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                s, t = sides[0][x], sides[1][y]
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    continue
                both = common(s, t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets are similar enough; texts: (node, text)."""
    met = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return met.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a long, b long")


def _alike(x: int, r: np.ndarray, root: np.ndarray, size: np.ndarray, sig: np.ndarray, bands: np.ndarray, bucket: int, percent: int) -> np.ndarray:
    """Of the members r those that x must be checked against in this bucket."""
    r = r[root[r] != root[x]]
    r = r[100 * np.minimum(size[r], size[x]) >= percent * np.maximum(size[r], size[x])]
    if len(r):
        r = r[(sig[r] == sig[x]).sum(axis=1) >= AGREE]
    if len(r):
        r = r[bands[x][(bands[r] == bands[x]).argmax(axis=1)] == bucket]  # elsewhere an earlier band has the pair
    return r


def _sides(side: np.ndarray, i: int, j: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each member of block i with those of block j that come after it."""
    left = np.flatnonzero(side == 0)
    right = left if i == j else np.flatnonzero(side == 1)
    for k, x in enumerate(left):
        yield x, right[k + 1 :] if i == j else right


def _search(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The members of a block pair that have a partner to be checked against."""
        bucket, i, j = (x.as_py() for x in key)
        table = table.sort_by("node")
        side, root, size = (table.column(c).to_numpy() for c in ("side", "root", "n"))
        sig = _rows_of(table.column("sig").combine_chunks())
        bands = band_keys(sig)
        keep = np.zeros(len(side), bool)
        for x, r in _sides(side, i, j):
            r = _alike(x, r, root, size, sig, bands, bucket, percent)
            if len(r):
                keep[x] = keep[r] = True
        return table.select(["bucket", "i", "j", "side", "node", "root"]).filter(pa.array(keep))

    return run


def _settle_block(percent: int):
    @tidy_group
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Links, confirmed on full sets, that join components of a block pair."""
        bucket, i, j = (x.as_py() for x in key)
        table = table.sort_by("node")
        side, node = table.column("side").to_numpy(), table.column("node").to_pylist()
        _, root = np.unique(table.column("root").to_numpy(), return_inverse=True)
        sets = [s for _, part in shingle_sets(table.column("text")) for s in part]
        size = np.array([len(s) for s in sets], np.int64)
        sig = signatures(sets)
        bands = band_keys(sig)
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(size)])
        marked = np.zeros(int(flat.max()) + 1, bool)
        links = []
        for x, r in _sides(side, i, j):
            r = _alike(x, r, root, size, sig, bands, bucket, percent)
            if not len(r):
                continue
            marked[flat[first[x] : first[x + 1]]] = True
            for y in r:
                both = int(np.count_nonzero(marked[flat[first[y] : first[y + 1]]]))
                if root[x] != root[y] and 100 * both >= percent * (size[x] + size[y] - both):
                    links.append((node[x], node[y]))
                    root[root == root[y]] = root[x]
            marked[flat[first[x] : first[x + 1]]] = False
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _rest(buckets: DataFrame, nodes: DataFrame, roots: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links between different components in buckets that hold several.

    A bucket is dealt out in blocks of bounded members and shingles. Block pairs are first
    searched by signature; only members with a partner to be checked then bring their texts.
    """
    rooted = buckets.join(roots, "node", "left").join(nodes.select("node", "n"), "node").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    open_ = rooted.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n").alias("sum"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    open_ = open_.select("bucket", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("sum") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = rooted.join(open_, "bucket").join(nodes.select("node", "sig"), "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side"), "node", "root", "n", "sig")
    met = rows.groupBy("bucket", "i", "j").applyInArrow(_search(percent), "bucket long, i int, j int, side int, node long, root long")
    return met.join(texts, "node").groupBy("bucket", "i", "j").applyInArrow(_settle_block(percent), "a long, b long")


def near_classes(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(row, n_shingles, class), settled, for docs (row, text), a table that reads the same rows each time.

    row: a number of each row's own. class: the smallest row of the class of rows that links join, null for a text without words.
    """
    sketched = settle(docs.select("row", "text").mapInArrow(_sketch, "row long, n_shingles long, digest binary, sig binary"), "sketches")
    nodes = settle(sketched.where("digest is not null").groupBy("digest").agg(F.min("row").alias("node"), F.max("n_shingles").alias("n"), F.max("sig").alias("sig")), "nodes")
    members = nodes.select("node", "sig").mapInArrow(_bucket, "bucket long, node long")
    stars = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("members")).where("members > 1").select("bucket", "centre")
    shared = settle(members.join(stars, "bucket"), "buckets")
    pairs = settle(shared.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    # a merge join at every size: the candidates grow with the documents, so a broadcast would not last
    texts = settle(docs.select("row", "text").join(wanted.hint("merge"), "row", "left_semi").select(F.col("row").alias("node"), "text"), "texts")
    found = settle(confirm(pairs, texts, percent), "links")
    roots = settle(components(found), "roots")
    more = settle(_rest(shared.select("bucket", "node"), nodes, roots, texts, percent), "links")
    if not more.isEmpty():
        roots = settle(components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")
    #: A row a set; settled, so that the join has exchanges of its own, which can be split where many rows share a set.
    classes = settle(nodes.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("class")), "classes")
    drop_settled(pairs, texts, shared, found, more, nodes)
    return settle(sketched.select("row", "n_shingles", "digest").join(classes, "digest", "left").select("row", "n_shingles", "class"), "row-classes")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    docs: any DataFrame with doc_id (long) and text; other columns, whatever their
    names, are left aside. component_id is the smallest doc_id that links reach, kept
    is doc_id = component_id. A text that is null, empty or blank has no shingles and
    links with nothing. Rows that repeat a doc_id each give a row; a null doc_id gets the
    smallest id of its component (null if there is none) and kept is false. An empty
    table gives an empty one.
    """
    rows = settle(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "rows")
    of = near_classes(rows, percent).join(rows.select("row", "doc_id"), "row")
    least = settle(of.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")).where("size > 1").drop("size"), "components")
    out = of.join(least, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each class that links join.

    Of a class the row with the smallest doc_id stays; of several with it, or where none has one, one of
    them. Texts that are null, empty or blank link with nothing and all stay. Column names
    but `__row` are free. An empty table gives an empty one.
    """
    rows = settle(docs.select("*", F.monotonically_increasing_id().alias("__row")), "rows")
    of = near_classes(rows.select(F.col("__row").alias("row"), "text"), percent)
    ids = rows.select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("__row")
    keep = of.where("class is not null").join(ids, "row").groupBy("class").agg(first).select("__row")
    keep = keep.unionByName(of.where("class is null").select(F.col("row").alias("__row")))
    return rows.join(keep, "__row", "left_semi").drop("__row")
