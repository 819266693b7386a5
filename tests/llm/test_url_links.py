"""Verdicts by links: exact ones by hand, and against a plain propagation and the SQL form."""

import duckdb
import numpy as np
import pytest
from oracle import assert_matches

from grainmill.llm import entry, urlfilter
from grainmill.llm.urlfilter import judge, propagate

PAGES = "page_id long, url string, html string"


def page(k, host, to, path="/"):
    return (k, f"http://{host}{path}", "".join(f'<a href="http://{t}/">' for t in to))


def verdicts(spark, rows):
    return {r["host"]: r["verdict"] for r in judge(spark.createDataFrame([page(k, h, to) for k, (h, to) in enumerate(rows)], PAGES)).collect()}


@pytest.mark.parametrize("linkers", [2, 100])
def test_linkers_to_one_blocked_host(spark, linkers):
    found = verdicts(spark, [("bad.net", []), ("fine.com", ["other.com"])] + [(f"h{k}.com", ["bad.net"]) for k in range(linkers)])
    assert {found[f"h{k}.com"] for k in range(linkers)} == {"block"} and found["fine.com"] == "allow"


def test_linkers_to_three_blocked_hosts(spark):
    bad = ["a.net", "b.net", "c.net"]
    found = verdicts(spark, [(b, []) for b in bad] + [(f"h{k}.com", bad) for k in range(5)] + [("mostly.com", ["a.net", *(f"ok{k}.com" for k in range(9))])])
    assert {found[f"h{k}.com"] for k in range(5)} == {"block"} and found["mostly.com"] == "allow"


def test_a_blocked_host_keeps_its_distrust(spark):
    found = verdicts(spark, [("bad.net", [f"ok{k}.com" for k in range(30)]), ("h.com", ["bad.net"]), ("g.com", ["bad.net"])])
    assert found["h.com"] == found["g.com"] == "block"


def test_a_chain_to_a_blocked_host(spark):
    """0.85 ** 4 is above a half, 0.85 ** 5 isn't; own and relative links change nothing."""
    found = verdicts(spark, [("bad.net", [])] + [(f"h{k}.com", [f"h{k - 1}.com" if k > 1 else "bad.net", f"h{k}.com"]) for k in range(1, 9)])
    assert [found[f"h{k}.com"] for k in range(1, 9)] == ["block"] * 4 + ["allow"] * 4


def test_trust_outweighs_distrust(spark):
    """Both link to a blocked host; one of them is linked to by trusted pages alone."""
    good = [page(k, f"good{k}.org", ["liked.com"], "/fr/") for k in range(3)]
    rows = [page(10, "bad.net", []), page(11, "liked.com", ["bad.net"]), page(12, "other.com", ["bad.net"]), *good]
    found = {r["host"]: r["verdict"] for r in judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert (found["liked.com"], found["other.com"], found["good1.org"]) == ("allow", "block", "allow")


def limit(edges, trust, distrust):
    """Scores by many steps over dense matrices."""
    n = len(trust)
    a = np.zeros((n, n))
    for s, d in edges:
        a[s, d] = 1
    a /= np.maximum(a.sum(1, keepdims=True), 1)
    t, d = np.zeros(n), distrust.copy()
    alone = np.ones(n, bool)
    alone[[x for e in edges for x in e]] = False
    for _ in range(400):
        t, d = 0.15 * trust + 0.85 * (a.T @ t), np.maximum(distrust, 0.15 * distrust + 0.85 * (a @ d))
    return np.where(alone, trust, t), np.where(alone, distrust, d)


@pytest.mark.parametrize("seed", range(2))
def test_against_plain_propagation(spark, seed):
    rng = np.random.default_rng(seed)
    n = 80
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (90 + 60 * seed, 2)) if a != b} | {(k, 0) for k in range(1, 30)})
    trust, distrust = np.where(rng.random(n) < 0.2, rng.random(n), 0), np.where(rng.random(n) < 0.3, 1.0, 0)
    t, d = limit(edges, trust, distrust)
    seeds = spark.createDataFrame([(f"h{k}", float(trust[k]), float(distrust[k])) for k in range(n) if trust[k] or distrust[k]], "host string, trust double, distrust double")
    found = {r["host"]: r for r in propagate(spark.createDataFrame([(f"h{a}", f"h{b}") for a, b in edges], "src string, dst string"), seeds).collect()}
    for k in range(n):
        r = found.get(f"h{k}")
        got = (r["trust"], r["distrust"]) if r else (0.0, 0.0)
        assert (got[1] - got[0] > 0.5) == (d[k] - t[k] > 0.5)
        assert got[0] <= t[k] + 1e-9 and got[1] <= d[k] + 1e-9
    assert 0 < sum(d - t > 0.5) < n


def test_sql_where_hosts_link(spark, tmp_path):
    rng = np.random.default_rng(0)
    hosts = [f"h{k}.{end}" for k in range(12) for end in ("com", "net", "org", "example.com")]
    rows = [page(k, h, rng.choice(hosts, rng.integers(0, 4)).tolist(), str(rng.choice(["/", "/fr/x", "/de/"]))) for k, h in enumerate(np.resize(hosts, 120).tolist())]
    rows += [(900, None, None), (901, "no scheme", "x"), (None, "http://h1.com/", None), (902, "HTTP://H1.com", '<img src="//h2.net/i">')]
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    found = judge(spark.read.parquet(f"{tmp_path}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict").collect()
    want = con.sql(urlfilter.oracle()).fetchall()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want)) and len({w[4] for w in want if w[3] is None}) == 2


def test_empty_pages(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert entry.queries()["op9_url_filter"](spark, str(tmp_path)).count() == 0
    assert judge(spark.createDataFrame([(1, None, None)], PAGES)).collect()[0]["verdict"] == "allow"


def test_query(spark, sf_dir):
    assert_matches(spark, sf_dir, entry.queries()["op9_url_filter"], entry.oracle_sql()["op9_url_filter"])
