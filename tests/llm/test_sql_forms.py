"""The SQL forms against the operators where rows repeat, are null or empty."""

import duckdb

from grainmill.llm import entry

PAGES = "page_id long, html string, url string"
DOCS = "doc_id long, text string, source string"


def both(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    found = entry.queries()[name](spark, str(tmp_path)).select(want.columns).collect()
    return sorted(str(tuple(r)) for r in found), sorted(map(str, want.fetchall()))


def test_archives(spark, tmp_path):
    html = [None, "", "<p>a</p>", "<p>ä</p>", "x" * 70_000]
    rows = [(i, html[i * i % 5], "") for i in range(40)] + [(100, "once", ""), (7, "twice", ""), (7, "twice", ""), (None, "<p>a</p>", ""), (None, "no id", "")]
    found, want = both(spark, tmp_path, "op2_warc_round_trip", "pages", rows, PAGES)
    assert found == want and sum("revisit" in w for w in want) > 20


def test_near_duplicates(spark, tmp_path, odd):
    rows = [r for r in odd if len(r[1] or "") < 1_000_000]
    found, want = both(spark, tmp_path, "op3_minhash_dedup", "documents", rows, DOCS)
    assert found == want and sum("False" in w for w in want) > 90
