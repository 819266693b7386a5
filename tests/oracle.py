"""Compares a query's rows with those of its DuckDB form."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def assert_matches(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found, want = query(spark, sf_dir), con.sql(sql)
    names = sorted(want.columns)
    assert sorted(found.columns) == names
    at = [want.columns.index(c) for c in names]
    assert sorted(map(str, (tuple(r) for r in found.select(names).collect()))) == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())
