"""Clusters of similarity hashes: by equality, and by the nearest leader within a radius.

Leader clustering takes keys in order of arrival: a key joins the nearest leader no further
than the radius (the lower one in a tie), or becomes a leader. Whether a key leads depends on
earlier keys within the radius only, so the key space is cut into cells that are folded in
parallel; a key whose answer hangs on one beyond its cell stays open, and is
folded again in a wider cell, which has its neighbours inside. Points then meet the few
leaders of their surroundings in an equi-join. So neither a dense run of keys nor a hot
key is one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.operators.ranking import ranked
from grainmill.session import settle

RADIUS = 10
#: Powers of two: the keys that a cell spans at first, and how much wider it gets from round to round.
CELL_BITS, WIDEN_BITS = 16, 4
OPEN, COVERED, LEADER, NEW = range(4)
_LAST = (1 << 63) - 1
#: Leaders that others meet at once, and pairs that a task of `leader_distances` makes.
PAIR_BLOCK, TASK_PAIRS = 4096, 1 << 26


def cluster_points(points: DataFrame, method: str = "leader", radius: int = RADIUS, known: DataFrame | None = None) -> DataFrame:
    """Adds cluster_id to points (sim_hash, arrival, ...) by the method: leader or equal."""
    if method == "leader":
        return leader_clusters(points, radius, known)
    if method == "equal":
        return equal_clusters(points)
    raise ValueError(f"no such method: {method}")


def equal_clusters(points: DataFrame) -> DataFrame:
    """Adds cluster_id, the similarity hash itself."""
    return points.withColumn("cluster_id", F.col("sim_hash"))


def islands(keys: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(key, island) for distinct keys (key): island is the smallest key of the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, start = TaskContext.get().partitionId(), None, None
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                start = key if last is None or key - last > radius else start
                last = key
                out.append(start)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64()), pa.array([part] * len(out), pa.int64())], ["key", "start", "part"])

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = settle(keys.distinct().repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, "key long, start long, part long"), "islands")
    border = local.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max("start").alias("open"))
    order = Window.orderBy("part")
    border = border.withColumn("joins", F.coalesce(F.col("low") - F.lag("high").over(order) <= radius, F.lit(False)))
    # an island that goes on over whole partitions keeps the start it had where it began
    began = F.when(~F.col("joins") | (F.col("open") != F.col("low")), F.col("open"))
    border = border.withColumn("carried", F.when(F.col("joins"), F.last(began, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))))
    return local.join(border.select("part", "low", "carried"), "part").select("key", F.when(F.col("start") == F.col("low"), F.coalesce("carried", "start")).otherwise(F.col("start")).alias("island"))


def fold_leaders(keys: list[int], radius: int) -> list[int]:
    """The leader of each key, in order of arrival."""
    leaders: list[int] = []
    out = []
    for key in keys:
        k = bisect_left(leaders, key)
        near = [x for x in leaders[max(0, k - 1) : k + 1] if abs(x - key) <= radius]
        best = min(near, key=lambda x: (abs(x - key), x)) if near else key
        if not near:
            insort(leaders, key)
        out.append(best)
    return out


def decide(rows: list[tuple[int, int | None, int, bool]], radius: int) -> list[int]:
    """The state of each (key, since, state, inner) after a fold over one cell.

    Rows are leaders and open keys of the cell, and those beyond its borders (not inner). A key is covered
    by a leader within the radius; one beyond the border, or near an earlier key in
    doubt, is in doubt itself; any other leads.
    """
    wide = radius + 1
    #: At most one leader fits into a slot of this width, and keys of one slot are near each other.
    leaders = {key // wide: key for key, _, state, _ in rows if state == LEADER}
    doubts: dict[int, tuple[int, int]] = {}
    out = [state for _, _, state, _ in rows]
    for i in sorted((i for i, r in enumerate(rows) if r[2] == OPEN), key=lambda i: (rows[i][1], rows[i][0])):
        key, inner = rows[i][0], rows[i][3]
        slot = key // wide
        if any(abs(leaders[x] - key) <= radius for x in (slot - 1, slot, slot + 1) if x in leaders):
            out[i] = COVERED
            continue
        below, above = doubts.get(slot - 1), doubts.get(slot + 1)
        if not inner or slot in doubts or (below and key - below[1] <= radius) or (above and above[0] - key <= radius):
            low, high = doubts.get(slot, (key, key))
            doubts[slot] = min(low, key), max(high, key)
        else:
            leaders[slot] = key
            out[i] = NEW
    return out


def _around(key: str, bits: int, radius: int) -> tuple[Column, Column, Column]:
    """The cell of 2^bits keys, and whether the radius reaches into the one below and above."""
    at = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    return F.shiftright(key, bits), at < radius, at >= (1 << bits) - radius


def _views(rows: DataFrame, key: str, bits: int, radius: int) -> DataFrame:
    """Rows once for each cell that the radius reaches from them, as _view; _cell is their own."""
    cell, low, high = _around(key, bits, radius)
    reach = F.array_compact(F.array(cell, F.when(low, cell - 1), F.when(high, cell + 1)))
    return rows.withColumn("_cell", cell).withColumn("_view", F.explode(reach))


def leaders(keys: DataFrame, radius: int = RADIUS, known: DataFrame | None = None) -> DataFrame:
    """(key, since) of the keys (key, since) that lead; known leaders (key) were there before all, since null.

    A round leaves open what hangs on keys over a border of its cells: few where arrival and
    key are unrelated. Cells widen until none is open, at last to all keys that still are.
    """

    names = ("key", "since", "state")

    def fold(view: int, part: list[tuple[int, int | None, int, int]]) -> list[tuple[int, int | None, int]]:
        found = decide([(key, since, state, cell == view) for key, since, state, cell in part], radius)
        return [(r[0], r[1], x) for r, x in zip(part, found, strict=True) if r[3] == view and x != COVERED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Folds view after view of a partition that is sorted by them."""
        now, part = None, []
        for batch in batches:
            out = []
            for key, since, state, cell, view in zip(*(batch.column(c).to_pylist() for c in (*names, "_cell", "_view")), strict=True):
                if view != now:
                    out += fold(now, part) if part else []
                    now, part = view, []
                part.append((key, since, state, cell))
            yield _folded(out)
        if part:
            yield _folded(fold(now, part))

    def _folded(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names)

    rows = keys.select("key", "since", F.lit(OPEN).alias("state"))
    found = []
    if known is not None:
        old = known.select("key", F.lit(None).cast("long").alias("since")).distinct()
        found.append(old)
        rows = rows.unionByName(old.withColumn("state", F.lit(LEADER)))
    bits = max(CELL_BITS, radius.bit_length())
    while True:
        if bits <= 60:
            views = _views(rows, "key", bits, radius)
        else:
            views = rows.withColumn("_cell", F.lit(0)).withColumn("_view", F.lit(0))
        views = views.select("key", "since", "state", "_cell", "_view").repartition("_view").sortWithinPartitions("_view")
        now = settle(views.mapInArrow(run, "key long, since long, state int"), "leaders")
        found.append(now.where(F.col("state") == NEW).select("key", "since"))
        open_ = now.where(F.col("state") == OPEN)
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found)
        # within its cell a leader has covered what it can; at a border it goes on
        _, low, high = _around("key", bits, radius)
        rows = open_.unionByName(now.where((F.col("state") != OPEN) & (low | high)).withColumn("state", F.lit(LEADER)))
        bits += WIDEN_BITS


def leader_clusters(points: DataFrame, radius: int = RADIUS, known: DataFrame | None = None) -> DataFrame:
    """Adds island and cluster_id (the leader's key) to points (sim_hash, arrival, ...).

    known: leaders (key) of earlier runs, which come before all points. Of points that arrive at once the lower
    key is first; a point without arrival comes last, one without sim_hash takes no part.
    """
    points = points.where("sim_hash is not null")
    arrival = F.coalesce("arrival", F.lit(_LAST))
    first = points.groupBy(F.col("sim_hash").alias("key")).agg(F.min(arrival).alias("since"))
    led = leaders(first, radius, known)
    bits = radius.bit_length()
    near = _views(led, "key", bits, radius).groupBy("_view").agg(F.collect_list(F.struct("key", "since")).alias("_leaders"))
    met = points.withColumn("_view", F.shiftright("sim_hash", bits)).join(near, "_view")
    own = F.col("sim_hash")

    def there(x: Column) -> Column:
        before = x["since"].isNull() | (x["since"] < arrival) | ((x["since"] == arrival) & (x["key"] <= own))
        return before & (F.abs(x["key"] - own) <= radius)

    best = F.array_min(F.transform(F.filter("_leaders", there), lambda x: F.struct(F.abs(x["key"] - own).alias("d"), x["key"].alias("key"))))
    met = met.withColumn("cluster_id", best["key"]).drop("_view", "_leaders")
    run = islands(points.select(F.col("sim_hash").alias("key")), radius).withColumnRenamed("key", "sim_hash")
    return met.join(run, "sim_hash").select(*points.columns, "island", "cluster_id")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("members"))


def member_distances(clusters: DataFrame) -> DataFrame:
    """Distance of each member but the leading one to its cluster's key."""
    first = clusters.groupBy("cluster_id").agg(F.min("arrival").alias("first"))
    return clusters.join(first, "cluster_id").where("arrival > first").select("cluster_id", "arrival", F.abs(F.col("sim_hash") - F.col("cluster_id")).alias("distance"))


def leader_distances(clusters: DataFrame) -> DataFrame:
    """Distances between all leaders: a report of quadratic size by its nature.

    Leaders meet blocks of about PAIR_BLOCK of them, so a task holds one block at a time, and tasks are so many
    that each makes about TASK_PAIRS rows.
    """
    a = settle(clusters.select("cluster_id").distinct(), "leading")
    n = a.count()
    dealt = F.pmod(F.xxhash64("cluster_id"), F.lit(-(-n // PAIR_BLOCK) or 1))
    blocks = a.groupBy(dealt.alias("_block")).agg(F.collect_list("cluster_id").alias("_others")).select("_others")
    parts = max(int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n * n // TASK_PAIRS, n // 16))
    met = a.repartition(parts, "cluster_id").crossJoin(blocks.hint("shuffle_replicate_nl")).select("cluster_id", F.explode("_others").alias("other_id"))
    return met.where("cluster_id <> other_id").select("cluster_id", "other_id", F.abs(F.col("cluster_id") - F.col("other_id")).alias("distance"))


def cluster_totals(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.count("*").alias("total_points"), F.count_distinct("cluster_id").alias("clusters"))


def with_parents(clusters: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Adds is_parent (first arrival of the cluster), parent_sha256 and the delta's ordinal among those of its own hash.

    A cluster whose key is the hash of a parent in the store `held` has that one as its parent, and
    ordinals go on after the held ones of the hash.
    """
    first = clusters.groupBy("cluster_id").agg(F.min(F.struct("arrival", "sha256")).alias("first"))
    first = first.select("cluster_id", F.col("first.sha256").alias("parent_sha256"))
    if held is not None:
        old = parents_of(held).select(F.col("key").alias("cluster_id"), F.col("sha256").alias("old_sha256"))
        first = first.join(old, "cluster_id", "left").select("cluster_id", F.coalesce("old_sha256", "parent_sha256").alias("parent_sha256"))
    out = clusters.join(first, "cluster_id").withColumn("is_parent", F.col("sha256") == F.col("parent_sha256"))
    out = out.select(*clusters.columns, "is_parent", "parent_sha256")
    children = ranked(out.where("not is_parent"), ["sim_hash"], ["arrival", "sha256"], "ordinal")
    if held is not None:
        deltas = held.where("parent_sha256 is not null").groupBy(F.col("hash").alias("sim_hash")).agg(F.count("*").alias("held_deltas"))
        children = children.join(deltas, "sim_hash", "left").withColumn("ordinal", F.col("ordinal") + F.coalesce("held_deltas", F.lit(0))).drop("held_deltas")
    return out.where("is_parent").withColumn("ordinal", F.lit(None).cast("long")).unionByName(children)


def parents_of(held: DataFrame) -> DataFrame:
    """(key, sha256) of the parents in a store: one for each similarity hash."""
    return held.where("kind = 'simple' and parent_sha256 is null and hash is not null").groupBy(F.col("hash").alias("key")).agg(F.min("sha256").alias("sha256"))
