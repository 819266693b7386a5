import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grainmill.functions import sampled, spectral
from grainmill.functions.gear import GEAR64, rolling
from grainmill.operators import chunking, cluster, store
from grainmill.operators.ranking import ranked
from grainmill.plans.pipeline import SimilarityPipeline


def test_pair_fold_vector():
    assert spectral.fold_pair(175, 113) == 0b11111111110


def test_p_part_takes_ranks_five_to_eight():
    pairs = np.array([(175 + i) * 256 + 113 for i in range(6)])
    assert spectral.p_part(pairs) == spectral.fold_pair(180, 113) << 20
    assert spectral.p_part(pairs[:5]) == 0


def test_spectral_hash_edge_cases():
    assert spectral.spectral_hash(b"") == 0
    data = bytes(np.random.default_rng(1).integers(0, 256, 8192, dtype=np.uint8))
    assert spectral.spectral_hash(data) == spectral.spectral_hash(data)
    assert 0 <= spectral.spectral_hash(data) < 1 << 32


@given(st.binary(max_size=200))
@settings(max_examples=50, deadline=None)
def test_rolling_is_a_bounded_window(data):
    fp, mask = 0, (1 << 64) - 1
    for i, b in enumerate(data):
        fp = (fp << 1) + int(GEAR64[b]) & mask
        assert int(rolling(np.frombuffer(data, np.uint8), 32)[i]) & 0xFFFFFFFF == fp & 0xFFFFFFFF


def test_sketch():
    assert sampled.sketch(b"") is None
    data = bytes(np.random.default_rng(2).integers(0, 256, 20000, dtype=np.uint8))
    assert len(sampled.sketch(data)) == 3
    assert sampled.neighbours([0, 0, (1 << 64) - 1])[0] == [0, 1, 0]


@given(st.binary(max_size=6000))
@settings(max_examples=40, deadline=None)
def test_bounded_cuts(data):
    starts = chunking.bounded_cuts(data, 64, 256, 512)
    sizes = np.diff([*starts, len(data)])
    assert starts[0] == 0 and (sizes <= 512).all() and (sizes[:-1] >= 64).all()


def by_hand(keys, radius):
    leaders, out = [], []
    for k in keys:
        near = [x for x in leaders if abs(x - k) <= radius]
        if near:
            out.append(min(near, key=lambda x: (abs(x - k), x)))
        else:
            leaders.append(k)
            out.append(k)
    return out


@given(st.lists(st.integers(0, 120), max_size=60), st.integers(0, 12))
@settings(max_examples=200, deadline=None)
def test_fold_leaders(keys, radius):
    assert cluster.fold_leaders(keys, radius) == by_hand(keys, radius)


@pytest.mark.parametrize("partitions", ["2", "8"])
def test_islands_and_leaders(spark, partitions):
    keys = np.random.default_rng(3).integers(0, 4000, 500).tolist()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    points = spark.createDataFrame(list(enumerate(keys)), "arrival long, sim_hash long")
    found = cluster.leader_clusters(points, 3).orderBy("arrival").collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r["cluster_id"] for r in found] == by_hand(keys, 3)
    distinct, island, want = sorted(set(keys)), None, {}
    for a, k in zip([None, *distinct], distinct, strict=False):
        island = k if a is None or k - a > 3 else island
        want[k] = island
    assert {r["sim_hash"]: r["island"] for r in found} == want


def test_free_cells():
    assert store.free_cells([5, 5, 5, 5, 0, 0]) == [5, 6, 4, 7, 0, 1]


@pytest.mark.parametrize("keys", [list(range(60)), list(range(60, 0, -1)), [0, 40, -40, 3, 6, 9, -3, -6, 20, 20, 17], [1 << 40, -(1 << 40), (1 << 40) + 2, 5, 8, 2]])
def test_leaders_of_chains_over_cells(spark, monkeypatch, keys):
    monkeypatch.setattr(cluster, "CELL_BITS", 2)
    points = spark.createDataFrame(list(enumerate(keys)), "arrival long, sim_hash long")
    found = cluster.leader_clusters(points, 3).orderBy("arrival").collect()
    assert [r["cluster_id"] for r in found] == by_hand(keys, 3)


@given(st.lists(st.integers(-40, 40), max_size=40, unique=True), st.integers(0, 5), st.integers(3, 5))
@settings(max_examples=200, deadline=None)
def test_cells_agree_with_the_fold(keys, radius, bits):
    want = set(by_hand(keys, radius))
    for cell in range(-40 >> bits, (40 >> bits) + 1):
        rows = [(k, t, cluster.OPEN, k >> bits == cell) for t, k in enumerate(keys) if (cell << bits) - radius <= k < ((cell + 1) << bits) + radius]
        for (key, _, _, inner), state in zip(rows, cluster.decide(rows, radius), strict=True):
            assert not inner or state == cluster.OPEN or (state == cluster.NEW) == (key in want)
        whole = [(k, t, cluster.OPEN, True) for t, k in enumerate(keys)]
    assert {k for k, state in zip(keys, cluster.decide(whole, radius), strict=True) if state == cluster.NEW} == want


def test_leaders_of_earlier_runs_odd_points(spark):
    keys = [10, 14, 30, 12, 33, 28]
    schema = "arrival long, sim_hash long, sha256 string, island string"
    points = spark.createDataFrame([(t, k, str(t), "x") for t, k in enumerate(keys)] + [(None, 34, "n", "x"), (9, None, "m", "x")], schema).drop("island")
    known = spark.createDataFrame([(13,), (13,)], "key long")
    found = {r["sha256"]: r["cluster_id"] for r in cluster.leader_clusters(points, 3, known).collect()}
    assert found == {"0": 13, "1": 13, "2": 30, "3": 13, "4": 30, "5": 30, "n": 34}
    assert cluster.leader_clusters(points.limit(0), 3).count() == 0


def test_ranks_of_hot_groups(spark):
    rows = [(k % 3 // 2, (k * 37) % 1000) for k in range(1000)]
    found = ranked(spark.createDataFrame(rows, "g long, at long"), ["g"], ["at"], "nth").collect()
    for g in (0, 1):
        assert [(r["at"], r["nth"]) for r in sorted((r for r in found if r["g"] == g), key=lambda r: r["at"])] == [(at, n) for n, at in enumerate(sorted(at for own, at in rows if own == g))]


@pytest.mark.parametrize("clusterer", ["leader", "equal"])
def test_scrub_again(spark, clusterer):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, 3000, dtype=np.uint8)
    files = []
    for k in range(6):
        copy = base.copy()
        copy[100 * k] ^= 1
        files.append((k, bytes(copy)))
    plan = SimilarityPipeline(sizes=(256, 1024, 4096), clusterer=clusterer)
    table = spark.createDataFrame(files, "file_id long, content binary")
    held, _ = plan.scrub(table.where("file_id < 3"))
    kept, recipes = plan.scrub(table, held)
    assert kept.count() == kept.select("sha256").distinct().count() > held.count()
    assert held.exceptAll(kept).count() == 0
    ordinals = kept.where("parent_sha256 is not null").groupBy("hash", "ordinal").count()
    assert ordinals.where("count > 1").count() == 0
    assert {r["file_id"]: bytes(r["content"]) for r in plan.read(kept, recipes).collect()} == dict(files)
