"""All pairs of leaders are made by many tasks, a block at a time."""

from grainmill.operators import cluster


def test_pairs_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(cluster, "PAIR_BLOCK", 16, raising=False)
    keys = [(k * k * 7,) for k in range(200)]
    found = cluster.leader_distances(spark.createDataFrame(keys + keys[:50], "cluster_id long"))
    tasks = [len(x) for x in found.rdd.glom().collect()]
    assert sum(n > 0 for n in tasks) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = sorted((a, b, abs(a - b)) for (a,) in keys for (b,) in keys if a != b)
    assert sorted(map(tuple, found.collect())) == want


def test_none(spark):
    assert cluster.leader_distances(spark.createDataFrame([], "cluster_id long")).count() == 0
