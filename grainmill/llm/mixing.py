"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source, its documents in order of doc_id, form one line that is cut into
blocks of `block` words. A source's target fixes how many blocks the mix takes from it, to the
word: whole passes over the line, and a part of one more. A keyed Feistel permutation per
source and pass puts the blocks in drawing order.

The tree spreads these quotas, one for each source and pass, over the output shards: at a
node, the left half of the shards gets a multivariate hypergeometric draw of the node's quotas, the
right half the rest, down to single shards, so quotas add up exactly at every level. The shards'
quotas cut each drawing order into stretches, one a shard; a shard draws its quota from its own
stretch, disjoint from all others, and shuffles what it drew by a keyed hash. So the
tree decides which shard draws a block, and in the part of a pass also whether one does: another split, or
another number of shards, draws other blocks to the same total.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.words import U64, mix
from grainmill.llm.worker import text_slices, tidy
from grainmill.session import settle

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 128
WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2.0
#: Sources carry weights, so they are few; their plan (one row each) goes to every task.
MAX_SOURCES = 100_000
_RUN = "row long, doc_id long, source string, size long, part int, before long"


def source_plan(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, source_size, target: `share` of all words by weight, at most `limit` times a source's size.

    Sources in code point order, null last, take the weights in turn. In order of size by
    weight, a source is full if what is left, dealt by weight among it and those after it,
    would exceed its limit; the first that isn't gives the rate of all the rest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    per = per.withColumn("most", F.col("source_size") * F.lit(limit))
    order = [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()]
    before, after = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("rate", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    free = F.when(F.col("most") > F.col("weight") * F.col("rate"), F.struct(F.col("most") / F.col("weight"), F.col("rate")))
    per = per.withColumn("rate", F.min(free).over(everything)["rate"])
    return per.select("source", "source_size", F.coalesce(F.least("most", F.col("weight") * F.col("rate")), "most").alias("target"))


def _log_ratio(n: int, d: int) -> float:
    """log((n + d)! / n!), without the loss of digits that a difference of two large logarithms has."""
    m = n + d
    if n < 1000 or m < 1000:
        return math.lgamma(m + 1) - math.lgamma(n + 1)
    tail = [1 / (12 * x) - 1 / (360 * x**3) for x in (n, m)]
    return (n + 0.5) * math.log1p(d / n) + d * math.log(m) - d + tail[1] - tail[0]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` items without replacement are good, by ratio of uniforms, for any sizes.

    Points under a hat over the square root of the law are accepted by its logarithm relative to the mode.
    """
    total = good + bad
    if min(good, bad, draws, total - draws) == 0:
        return good if draws == total else draws if not bad else 0
    few, taken = min(good, bad), min(draws, total - draws)  # the law of the rarer kind in the smaller part
    share = few / total
    width = math.sqrt((total - taken) / (total - 1) * taken * share * (1 - share) + 0.5)
    scale = 2 * math.sqrt(2 / math.e) * width + 3 - 2 * math.sqrt(3 / math.e)
    mode = (taken + 1) * (few + 1) // (total + 2)
    room = total - few - taken
    while True:
        x, y = rng.random(2)
        if not x:
            continue
        k = math.floor(taken * share + 0.5 + scale * (y - 0.5) / x)
        if not max(0, -room) <= k <= min(few, taken):
            continue
        d = k - mode
        if 2 * math.log(x) <= -(_log_ratio(mode, d) + _log_ratio(few - mode, -d) + _log_ratio(taken - mode, -d) + _log_ratio(room + mode, d)):
            break
    if good > bad:
        k = taken - k
    return k if draws == taken else good - k


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Quotas of each shard (rows) and column; columns add up to `quotas`, and shards to within one of each other at every node."""
    out: list[list[int]] = [[]] * shards

    def node(lo: int, hi: int, left: list[int]) -> None:
        if hi - lo == 1:
            out[lo] = left
            return
        mid, rng = (lo + hi) // 2, np.random.default_rng([seed, lo, hi])
        rest, draws, here = sum(left), sum(left) * (mid - lo) // (hi - lo), []
        for q in left:
            got = hypergeometric(rng, q, rest - q, draws)
            here.append(got)
            rest, draws = rest - q, draws - got
        node(lo, mid, here)
        node(mid, hi, [a - b for a, b in zip(left, here, strict=True)])

    node(0, shards, list(quotas))
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed Feistel permutation of [0, n) puts `index`."""
    half = max(1, math.ceil(math.log2(max(2, n)) / 2))
    mask, out = U64((1 << half) - 1), index.astype(U64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> U64(half), out[todo] & mask
        for r in range(4):
            left, right = right, left ^ (mix(right + U64((key + r * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) & mask)
        out[todo] = left << U64(half) | right
        todo = todo[out[todo] >= U64(n)]
    return out.astype(np.int64)


class _Source:
    """A source's line of blocks, and what each shard draws from it in each pass."""

    def __init__(self, name: str | None, size: int, target: float, seed: int, block: int = BLOCK):
        self.key = int.from_bytes(hashlib.blake2b(f"{seed}:{'' if name is None else 's' + name}".encode(), digest_size=8).digest(), "little")
        words = min(round(target), 2 * size) if size else 0
        self.passes, self.part = divmod(words, size) if size else (0, 0)
        self.block, self.full, self.blocks = block, size // block, -(-size // block)
        #: Blocks to be drawn in each pass: all of them, and in the last pass those of the part.
        self.quotas = [self.blocks] * self.passes + ([-(-self.part // block)] if self.part else [])

    def deal(self, quotas: list[list[int]]) -> None:
        """Gives each shard its stretch of each pass's drawing order; quotas: by shard, of each pass.

        Stretches lie side by side. In a whole pass one is as long as its shard's quota; in the part the line is
        cut in proportion to the quotas, and a shard draws the first blocks of its stretch up to its quota.
        """
        self.stretches = []
        for p, quota in enumerate(self.quotas):
            line = quota if p < self.passes else self.full if quota <= self.full else self.blocks
            done = list(itertools.accumulate(q[p] for q in quotas))
            ends = [d * line // quota for d in done]
            self.stretches.append(tuple(np.array(x, np.int64) for x in (ends, [0, *ends[:-1]], [0, *done[:-1]], [q[p] for q in quotas])))

    def draws(self, first: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """What the mix takes of documents that hold words [first, first + size) of the line.

        Columns: index of the document, shard, place in the order of its pass, pass, from word, to word.
        """
        some = np.flatnonzero(size > 0)
        begin, end = first[some], first[some] + size[some]
        count = (end - 1) // self.block - begin // self.block + 1
        of = np.repeat(np.arange(len(some)), count)
        block = begin[of] // self.block + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        out = []
        for p, (ends, starts, before, quota) in enumerate(self.stretches):
            at = np.full(len(block), self.full)  # the short block at the end of the line is last in order
            whole = block < self.full
            at[whole] = permuted(block[whole], self.full, self.key + p)
            shard = np.minimum(np.searchsorted(ends, at, side="right"), len(ends) - 1)
            nth = at - starts[shard]
            words = np.full(len(at), self.block)
            if p == self.passes:  # of the part's last draw only what is left
                words = np.where(nth < quota[shard], np.minimum(self.block, self.part - (before[shard] + nth) * self.block), 0)
            lo, hi = np.maximum(begin[of], block * self.block), np.minimum(end[of], block * self.block + words)
            got = hi > lo
            out.append(np.stack([some[of], shard, at, np.full(len(at), p), lo - begin[of], hi - begin[of]])[:, got])
        return list(np.concatenate(out, axis=1)) if out else [np.zeros(0, np.int64)] * 6


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and the words that come before in this partition and source."""
    part, now, total = TaskContext.get().partitionId(), object(), 0
    for batch in batches:
        before = []
        for source, size in zip(batch.column("source").to_pylist(), batch.column("size").to_pylist(), strict=True):
            if source != now:
                now, total = source, 0
            before.append(total)
            total += size
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "source", "size")), pa.array([part] * len(before), pa.int32()), pa.array(before, pa.int64())], ["row", "doc_id", "source", "size", "part", "before"])


def draws(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, shards: int = 64, seed: int = 7, row: str | None = None, block: int = BLOCK) -> DataFrame:
    """row, doc_id, size, source_size, target, taken, n_shards, draws: what the mix takes of each document.

    draws: array of (shard, at, pass, from_word, to_word), what each shard draws of it; `at` orders a shard. taken is
    the sum over all shards, n_shards says how many draw from the document. size is the
    number of words, 0 where the text is null or blank; such documents aren't drawn. A
    null source is one of its own, last in order. Documents are lined up by doc_id (null
    first) and a hash of the text, so the result doesn't depend on partitions; of rows
    equal in these it doesn't matter which is which. `row` names a column of docs with settled
    row numbers, for who joins on them; without it rows are numbered here, and the numbers
    hold for this result alone. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    sizes = settle(docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("tie")), "sizes")
    order = [F.col("source").asc_nulls_last(), "doc_id", "tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ran = settle(sizes.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_running, _RUN), "offsets")
    if sizes.select("source").distinct().count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = source_plan(sizes, weights, share, limit).collect()
    plan.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sources = {r["source"]: _Source(r["source"], r["source_size"], r["target"], seed, block) for r in plan}
    known = {r["source"]: (r["source_size"], r["target"], k) for k, r in enumerate(plan)}
    dealt, at = split_quotas([q for s in sources.values() for q in s.quotas], shards, seed), 0
    for s in sources.values():
        s.deal([row[at : at + len(s.quotas)] for row in dealt])
        at += len(s.quotas)
    base = ran.groupBy("part", "source").agg(F.sum("size").alias("words"))
    base = base.withColumn("base", F.sum("words").over(Window.partitionBy("source").orderBy("part")) - F.col("words")).select("part", F.col("source").alias("of"), "base")
    placed = ran.join(base, (ran["part"] == base["part"]) & ran["source"].eqNullSafe(base["of"])).select("row", "doc_id", "source", "size", (F.col("before") + F.col("base")).alias("first"))

    fields = [("shard", pa.int32()), ("at", pa.int64()), ("pass", pa.int32()), ("from_word", pa.int64()), ("to_word", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, first = batch.column("size").to_numpy(), batch.column("first").to_numpy()
            names = batch.column("source").to_pylist()
            rank = np.array([known[x][2] for x in names], np.int64)
            found = [np.zeros((6, 0), np.int64)]
            for name in dict.fromkeys(names):
                rows, k = np.flatnonzero(rank == known[name][2]), known[name][2]
                doc, shard, q, turn, lo, hi = sources[name].draws(first[rows], size[rows])
                at = mix((q * 2 + turn).astype(U64) + U64(sources[name].key)).view(np.int64)
                found.append(np.stack([rows[doc], shard, at, turn, lo, hi]))
            got = np.concatenate(found, axis=1)
            got = got[:, np.lexsort((got[4], got[3], got[0]))]
            taken = np.bincount(got[0], weights=got[5] - got[4], minlength=len(size)).astype(np.int64)
            meets = np.bincount(np.unique(got[:2], axis=1)[0], minlength=len(size))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(got[0], minlength=len(size)))]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(got[i + 1].astype(kind_.to_pandas_dtype())) for i, (_, kind_) in enumerate(fields)], [f for f, _ in fields])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("size"), pa.array([known[x][0] for x in names], pa.int64()), pa.array([known[x][1] for x in names], pa.float64()), pa.array(taken), pa.array(meets), pa.ListArray.from_arrays(pa.array(offsets), items)], ["row", "doc_id", "size", "source_size", "target", "taken", "n_shards", "draws"])

    # dealt out anew: rows are narrow, but each is worked on for as long as it has blocks
    return placed.repartition(parts, "row").mapInArrow(run, "row long, doc_id long, size long, source_size long, target double, taken long, n_shards long, draws array<struct<shard:int,at:long,pass:int,from_word:long,to_word:long>>")


_WORD = regex.compile(WORD)


def _excerpt(text: str, ranges: list[tuple[int, int]], size: int) -> str:
    """The words of the ranges, with the text's own spacing inside a run; runs are lines."""
    runs: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if runs and runs[-1][1] == lo:
            runs[-1][1] = hi
        else:
            runs.append([lo, hi])
    if runs == [[0, size]]:
        return text
    words, at, out = _WORD.finditer(text), 0, []
    for lo, hi in runs:
        first = next(itertools.islice(words, lo - at, None))
        last = next(itertools.islice(words, hi - lo - 2, None)) if hi - lo > 1 else first
        out.append(text[first.start() : last.end()])
        at = hi
    return "\n".join(out)


def _with_draws(docs: DataFrame, **options) -> DataFrame:
    #: Settled with their numbers, which a second read may deal out otherwise.
    rows = settle(docs.select("*", F.monotonically_increasing_id().alias("__row")), "rows")
    drawn = draws(rows, row="__row", **options).where("taken > 0").select(F.col("row").alias("__row"), F.col("size").alias("__size"), F.col("draws").alias("__draws"))
    return rows.join(drawn, "__row").drop("__row")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of documents: a row for each pass that draws from one.

    Null, empty and blank texts aren't drawn; rows that repeat are documents of their own, and a null doc_id
    stays null. An empty table gives an empty one. A pass that takes all of a document has its text as it is; one that takes some blocks has
    their words, runs of adjoining blocks as lines, and n_chars counts them.
    """
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in text_slices(batch, "text")):
            out = []
            for d in part.to_pylist():
                for p in sorted({x["pass"] for x in d["__draws"]}):
                    text = _excerpt(d["text"], [(x["from_word"], x["to_word"]) for x in d["__draws"] if x["pass"] == p], d["__size"])
                    out.append({"doc_id": d["doc_id"], "text": text, "lang": d["lang"], "source": d["source"], "n_chars": d["n_chars"] if text == d["text"] else len(text)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]))

    return _with_draws(docs.select("doc_id", "text", "lang", "source", "n_chars"), **options).mapInArrow(run, schema)


def mix_blocks(docs: DataFrame, shards: int = 64, **options) -> DataFrame:
    """The mix as shards of shuffled blocks: shard, at, doc_id, text; partition k is shard k, in order.

    Texts that are null, empty or blank have no block; an empty table gives an empty one.
    """
    schema = "shard int, at long, doc_id long, text string"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in text_slices(batch, "text")):
            out = [{"shard": x["shard"], "at": x["at"], "doc_id": d["doc_id"], "text": _excerpt(d["text"], [(x["from_word"], x["to_word"])], d["__size"])} for d in part.to_pylist() for x in d["__draws"]]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("shard", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())]))

    rows = _with_draws(docs.select("doc_id", "text", "source"), shards=shards, **options).mapInArrow(run, schema)
    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("at", "doc_id")
