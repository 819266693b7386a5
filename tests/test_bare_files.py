"""Files without bytes, empty or null, are read back as what they are."""

import pytest
from oracle import TABLES, assert_matches

from grainmill import catalogue


@pytest.fixture(scope="module")
def bare_dir(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("bare")
    rows = [(k, text, "en", "a", len(text or "")) for k, text in enumerate(["", "some text " * 300, None, "x", "", "some text " * 300 + "end", "ab" * 900])]
    for t in TABLES:
        if t != "documents":
            (out / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(out / "documents.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["q_content_chunks", "q_incremental_ingest", "q_restore_documents", "q_stored_files", "q_incremental_scrub", "q_mixed_store", "q_gear_chunks"])
def test_matches_sql(spark, bare_dir, name):
    assert_matches(spark, bare_dir, catalogue.queries()[name], catalogue.oracle_sql()[name])
