"""Near duplicates: recall on whole tables, rows without ids or with repeated ones, and what stays."""

import collections
import time

import duckdb
import numpy as np
from test_operators import DOCS, brute_near, docs_of

from grainmill.llm.minhash import near_duplicates, without_near_duplicates

SF = "/root/testdata/sf0.01/documents.parquet"


def test_recall_is_whole(spark):
    """All 1000 documents of sf0.01, against all pairs."""
    rows = [(i, t, "") for i, t in duckdb.sql(f"select doc_id, text from '{SF}'").fetchall()]
    found = near_duplicates(spark.read.parquet(SF)).collect()
    want = brute_near(rows)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == want
    assert sum(i != c for i, _, c in want) > 50


def test_rows_without_ids(spark):
    """Many of them, and many that repeat one id, cost no product of rows."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 30)) for _ in range(1500)]
    rows = [(None if k % 2 else 5, t, "a") for k, t in enumerate(texts)] + [(None if k % 3 else 5, t + " end", "a") for k, t in enumerate(texts[:200])]
    began = time.perf_counter()
    found = near_duplicates(docs_of(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] == 5) == collections.Counter((5, 26 + (k >= 1500), 5) for k, r in enumerate(rows) if r[0] == 5)
    assert len(found) == len(rows) and time.perf_counter() - began < 120
    assert without_near_duplicates(docs_of(spark, rows)).count() == 1500


def test_what_stays(spark, odd):
    odd = [*odd, (None, odd[12][1], "z"), (None, "alone without an id of its own", "z"), (777, odd[12][1] + " end", "z"), (777, "another text of this id", "z")]
    docs = docs_of(spark, odd)
    found = without_near_duplicates(docs)
    assert found.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in found.collect()]
    numbered = [(k if i is None else -10000 + i, t, s) for k, (i, t, s) in enumerate(odd)]
    blank = [(i, t) for i, t, _ in odd if not (t or "").split()]
    groups = collections.Counter(c for i, n, c in brute_near([(k, t, s) for k, (_, t, s) in enumerate(odd)]).elements() if n)
    assert len(numbered) == len(odd) and len(got) == len(groups) + len(blank)
    assert all(got.count(x) == blank.count(x) for x in blank)
    names = {i for i, t in got if (t or "").split()}
    assert {4, 7, 9, 100, None} <= names and 5 not in names and 8 not in names
    assert without_near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
