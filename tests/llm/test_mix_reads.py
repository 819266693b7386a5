"""The mix where the second read of the documents deals out files otherwise."""

from grainmill.llm import mixing


def test_texts_keep_their_draws(spark, tmp_path):
    rows = [(k, " ".join(f"d{k}w{j}" for j in range(1 + 37 * k % 400)), "en", "ab"[k % 2], 0) for k in range(240)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(24).write.parquet(path)
    name = "spark.sql.leafNodeDefaultParallelism"

    def run(then: int):
        spark.conf.set(name, 6)
        documents, blocks = mixing.mix_documents(spark.read.parquet(path)), mixing.mix_blocks(spark.read.parquet(path), shards=4)
        spark.conf.set(name, then)
        return sorted(map(tuple, documents.collect())), sorted(map(tuple, blocks.collect()))

    try:
        want, found = run(6), run(2)
    finally:
        spark.conf.unset(name)
    assert found == want and all(w.startswith(f"d{r[0]}w") for r in found[0] for w in r[1].split())
