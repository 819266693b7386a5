"""Registered queries of the similarity-deduplication engine and their DuckDB forms.

Each query runs over whole tables. The texts of documents, or the html of pages, are the
byte strings; equal texts are one point, which arrives with its smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import sampled, shingle, spectral
from grainmill.operators import chunking, cluster, codecs, store
from grainmill.plans.pipeline import SimilarityPipeline, cluster_report, dedup_ratios, storage_report
from grainmill.session import forget, settle, shared_path
from grainmill.sources.files import read_files, read_store, write_store
from grainmill.streaming.ingest import add_batch

FIXED, GEAR_BITS, SKETCH_BITS = 500, 10, 7
CHUNKS = (256, 1024, 4096)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, content."""
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").cast("binary").alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), F.col("html").cast("binary").alias("content"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumnRenamed("item_id", "file_id")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha256, arrival, sim_hash of each distinct text."""
    docs = documents(spark, sf_dir).where("content is not null")
    hashed = spectral.with_spectra(docs).select("item_id", F.sha2("content", 256).alias("sha256"), "sim_hash")
    return settle(hashed.groupBy("sha256").agg(F.min("item_id").alias("arrival"), F.first("sim_hash").alias("sim_hash")), "points")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(cluster.leader_clusters(points(spark, sf_dir)), "clusters")


def q_scan_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and SHA-256 of every document and page."""
    both = documents(spark, sf_dir).withColumn("origin", F.lit("documents")).unionByName(pages(spark, sf_dir).withColumn("origin", F.lit("pages")))
    return both.select("origin", "item_id", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def q_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct chunks of fixed size with their copies and first place."""
    return chunking.unique_chunks(chunking.fixed_chunks(files(spark, sf_dir), FIXED))


def q_fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(files(spark, sf_dir), FIXED).drop("data")


def q_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.gear_pieces(files(spark, sf_dir), GEAR_BITS).select("file_id", "seq", "offset", "length")


def q_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunks joined again: every file has its bytes."""
    chunks = chunking.content_chunks(files(spark, sf_dir), *CHUNKS, bare=True)
    whole = store.restore(chunks.select("file_id", "seq", "sha256"), chunks.select("sha256", "data").where("length(data) > 0").dropDuplicates(["sha256"]))
    return whole.select("file_id", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def q_chunk_dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_ratios(chunking.fixed_chunks(files(spark, sf_dir), FIXED))


def q_byte_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.byte_counts(documents(spark, sf_dir))


def q_bigram_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.pair_counts(documents(spark, sf_dir))


def _part(column: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spectral.with_spectra(documents(spark, sf_dir)).select("item_id", column)

    return query


def q_spectral_hash_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.with_spectra(pages(spark, sf_dir)).select("item_id", "sim_hash")


def q_neighbour_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, before = spectral.neighbour_hashes(F.col("sim_hash"))
    return spectral.with_spectra(documents(spark, sf_dir)).select("item_id", after.alias("next_hash"), before.alias("last_hash"))


def q_sampled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three features of every document, -1 where no byte is sampled."""
    f = F.col("features")
    return sampled.with_sketch(documents(spark, sf_dir), bits=SKETCH_BITS).select("item_id", *[F.coalesce(f[k], F.lit(-1)).alias(f"feature_{k}") for k in range(3)])


def q_sketch_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next and last sketch, digit by digit; the lowest digit is put to 0 where it is even, so that some borrow."""
    f = F.col("features")
    low = F.when(f[2] % 2 == 0, F.lit(0).cast("long")).otherwise(f[2])
    sketched = sampled.with_sketch(documents(spark, sf_dir), bits=SKETCH_BITS).where("features is not null").select("item_id", F.array(f[0], f[1], low).alias("features"))
    return sampled.with_neighbours(sketched).select("item_id", *[F.col(side)[k].alias(f"{side}_{k}") for side in ("next", "last") for k in range(3)])


def q_shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of each document in common with the document before it."""
    own = documents(spark, sf_dir).select("item_id", shingle.shingles(F.col("content")).alias("own"))
    before = own.select((F.col("item_id") + 1).alias("item_id"), F.col("own").alias("before"))
    return shingle.resemblance(own.join(before, "item_id"), "own", "before").select("item_id", "common", "united")


def q_eq_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_sizes(cluster.equal_clusters(points(spark, sf_dir)))


def q_leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark, sf_dir).select("arrival", "sim_hash", "cluster_id")


def q_incremental_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that arrive at even numbers, then the others, which meet the leaders of the first run."""
    every = points(spark, sf_dir)
    first = settle(cluster.leader_clusters(every.where("arrival % 2 = 0")), "clusters")
    then = cluster.leader_clusters(every.where("arrival % 2 <> 0"), known=first.select(F.col("cluster_id").alias("key")).distinct())
    return first.unionByName(then).select("arrival", "sim_hash", "cluster_id")


def q_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.islands(points(spark, sf_dir).select(F.col("sim_hash").alias("key")))


def q_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_sizes(clusters(spark, sf_dir))


def q_member_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.member_distances(clusters(spark, sf_dir))


def q_leader_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.leader_distances(clusters(spark, sf_dir))


def q_cluster_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_totals(clusters(spark, sf_dir))


def q_parent_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.with_parents(clusters(spark, sf_dir)).select("arrival", "cluster_id", "is_parent", "parent_sha256")


def q_delta_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.with_parents(cluster.equal_clusters(points(spark, sf_dir).withColumn("sim_hash", F.col("sim_hash") % 64))).where("not is_parent").select("arrival", "sim_hash", "ordinal")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the child of the one before it, or of an empty one."""
    docs = documents(spark, sf_dir)
    before = docs.select((F.col("item_id") + 1).alias("item_id"), F.col("content").alias("parent"))
    return docs.join(before, "item_id", "left").select("item_id", F.col("content").alias("child"), F.coalesce("parent", F.lit(b"")).alias("parent"))


def _turn_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, content, before, distance of all turns that have one before them."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("content"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("content").alias("before"))
    latin = lambda c: F.decode(c, "ISO-8859-1")
    return turns.join(before, ["conv_id", "turn"]).withColumn("distance", F.levenshtein(latin("content"), latin("before")).cast("long"))


def q_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte edit distance of every conversation turn to the turn before, whatever their sizes."""
    return _turn_distances(spark, sf_dir).select("conv_id", "turn", "distance")


def q_edit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an edit script of that distance is worth storing: never where sizes differ by more than the codec takes."""
    n, m = F.octet_length("content"), F.octet_length("before")
    worth = (F.abs(n - m) <= codecs.MOST_DIFFERENCE) & (4 * F.col("distance") + 4 <= n)
    return _turn_distances(spark, sf_dir).select("conv_id", "turn", worth.alias("worth"))


def q_edit_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scripts that the codec itself writes for those pairs: their steps are the distance, where they are shorter than the turn."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("child"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("child").alias("parent"))
    pairs = turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", "child", "parent")
    coded = store.encode_children(pairs, "editscript").select("conv_id", "turn", "kind", F.lit("editscript").alias("codec"), F.lit(False).alias("compressed"), "payload")
    return store.code_sizes(coded).select("conv_id", "turn", "kind", "steps")


def _round_trip(codec: str, compress: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = _pairs(spark, sf_dir).select("item_id", F.col("parent").alias("base"), "child", "parent")
        coded = store.encode_children(pairs, codec, compress).select("item_id", "kind", F.lit(codec).alias("codec"), F.lit(compress).alias("compressed"), "payload", F.col("base").alias("parent"))
        return store.decode_children(coded).select("item_id", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha256"))

    return query


#: Documents that make one file of `near copies`, so that sub-chunks of 8 KiB recur.
BUNDLE = 64


def _near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, child, parent: BUNDLE documents in a row, and the same with a byte replaced, one added and some moved.

    The child is the parent's last tenth, then the parent with its middle byte replaced by `#` and a `+` put in at a quarter.
    """
    docs = documents(spark, sf_dir).withColumn("bundle", F.floor(F.col("item_id") / BUNDLE)).where("content is not null")
    parts = docs.select(F.col("bundle").alias("file_id"), F.col("item_id").alias("seq"), F.sha2(F.concat(F.col("item_id").cast("string").cast("binary"), F.lit(b":"), "content"), 256).alias("sha256"), F.col("content").alias("data"))
    whole = store.restore(parts.select("file_id", "seq", "sha256"), parts.select("sha256", "data"))
    n, c = F.octet_length("content"), F.col("content")
    quarter, half, tail = F.floor(n / 4).cast("int"), F.floor(n / 2).cast("int"), F.floor(n / 10).cast("int")
    cut = lambda a, b: F.substring(c, a + 1, b - a)
    child = F.concat(cut(n - tail, n), cut(F.lit(0), quarter), F.lit(b"+"), cut(quarter, half), F.lit(b"#"), cut(half + 1, n))
    return whole.where(n >= 40).select(F.col("file_id").alias("item_id"), child.alias("child"), c.alias("parent"))


def q_delta_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of near copies by every codec that copies: sizes, whether they are deltas below a tenth or half of the data, and the data again.

    A delta has at least two steps, for the part that moved and what is behind it; what it copies and its size bound each other.
    """
    pairs = settle(_near_copies(spark, sf_dir), "near-copies")
    out = []
    for codec in ("gearword", "subchunk", "subchunk_speed", "subchunk_compression", "block", "lz_raw", "lz"):
        coded = settle(store.encode_children(pairs.select("item_id", F.col("parent").alias("base"), "child", "parent"), codec).select("item_id", F.lit(codec).alias("codec"), "kind", F.lit(False).alias("compressed"), "payload", F.col("base").alias("parent")), "codes")
        sizes = store.code_sizes(coded.select("item_id", "kind", "codec", "compressed", "payload"))
        whole = store.decode_children(coded.select("item_id", "kind", "codec", "compressed", "payload", "parent")).select("item_id", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha256"))
        both = sizes.join(whole, "item_id")
        total, codes = F.sum("n_bytes"), F.sum("payload_bytes")
        out.append(both.agg(
            F.lit(codec).alias("codec"), F.count("*").alias("pairs"), total.alias("raw_bytes"), F.bit_xor(F.conv(F.substring("sha256", 1, 15), 16, 10).cast("long")).alias("restored"),
            (2 * F.sum(F.when(F.col("kind") == "delta", 1).otherwise(0)) > F.count("*")).alias("mostly_deltas"), F.coalesce(F.min(F.when(F.col("kind") == "delta", F.col("steps"))) >= 1, F.lit(False)).alias("deltas_copy"),
            (codes < total).alias("shorter"), (2 * codes < total).alias("halved"),
        ))
    return reduce(DataFrame.unionByName, out)


def q_delta_editscript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts of documents whose first byte is replaced, middle byte removed and to which a byte is added: three steps, or fewer bytes raw."""
    c, n = F.col("content"), F.octet_length("content")
    half = F.floor(n / 2).cast("int")
    child = F.concat(F.lit(b"\x01"), F.substring(c, F.lit(2), half - 1), F.substring(c, half + 2, n), F.lit(b"\x02"))
    pairs = documents(spark, sf_dir).where(n >= 4).select("item_id", F.col("content").alias("base"), child.alias("child"), F.col("content").alias("parent"))
    coded = settle(store.encode_children(pairs, "editscript").select("item_id", F.lit("editscript").alias("codec"), "kind", F.lit(False).alias("compressed"), "payload", F.col("base").alias("parent")), "codes")
    sizes = store.code_sizes(coded.select("item_id", "kind", "codec", "compressed", "payload")).select("item_id", "kind", "payload_bytes", "steps")
    whole = store.decode_children(coded.select("item_id", "kind", "codec", "compressed", "payload", "parent"))
    return sizes.join(whole.select("item_id", F.sha2("data", 256).alias("sha256")), "item_id")


def q_lz_flag_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag and rest of every length and pointer kind, and both decoded again."""
    rows = [(size, kind, *codecs.lz_flag(size, kind), *codecs.lz_unflag(*codecs.lz_flag(size, kind))) for size in range(codecs.LZ_LEAST, codecs.LZ_MOST + 1) for kind in range(5)]
    return spark.createDataFrame(rows, "size long, kind long, flag long, rest long, size_again long, kind_again long")


def _scrubbed(spark: SparkSession, sf_dir: str) -> tuple[SimilarityPipeline, DataFrame, DataFrame]:
    plan = SimilarityPipeline(sizes=CHUNKS)
    return plan, *plan.scrub(files(spark, sf_dir))


def q_restore_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk, dedup, hash, cluster, encode, and read every document back from the store."""
    plan, kept, recipes = _scrubbed(spark, sf_dir)
    return plan.read(kept, recipes).select("file_id", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def q_incremental_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a store that half of the documents, and then all, went into."""
    docs, plan = files(spark, sf_dir), SimilarityPipeline(sizes=CHUNKS)
    held, _ = plan.scrub(docs.where("file_id % 2 = 0"))
    kept, recipes = plan.scrub(docs, held)
    return plan.read(kept, recipes).select("file_id", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def q_storage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage_report(_scrubbed(spark, sf_dir)[1])


def q_total_dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents over bytes in the store."""
    _, kept, _ = _scrubbed(spark, sf_dir)
    logical = documents(spark, sf_dir).agg(F.sum(F.octet_length("content")).alias("logical_bytes"))
    held = kept.agg(F.sum(F.octet_length("payload")).alias("stored_bytes"))
    return logical.join(held, F.lit(True)).withColumn("ratio", F.round(F.col("logical_bytes") / F.col("stored_bytes"), 6))


def q_cluster_dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and stored bytes per cluster of the store."""
    _, kept, _ = _scrubbed(spark, sf_dir)
    group = kept.groupBy(F.coalesce("parent_sha256", "sha256").alias("parent_sha256"))
    return group.agg(F.count("*").alias("members"), F.sum("raw_length").alias("raw_bytes"), F.sum(F.octet_length("payload").cast("long")).alias("stored_bytes"))


def _fixed_store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf_dir).select(F.sha2("content", 256).alias("sha256"), F.col("content").alias("data"))
    kept = store.build_store(docs.dropDuplicates(["sha256"]), cluster.with_parents(clusters(spark, sf_dir)))
    return kept, docs.select("sha256").distinct()


def q_mixed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back from a store that several codecs wrote: each row by its own."""
    parts = []
    docs, coded = files(spark, sf_dir), list(codecs.ENCODERS)
    for k, codec in enumerate(coded):
        plan = SimilarityPipeline(sizes=CHUNKS, clusterer="equal", codec=codec, compress=k % 2 == 1)
        parts.append(plan.scrub(docs.where(F.col("file_id") % len(coded) == k)))
    chunks = [store.get(kept, recipes.where(~store.bare()).select("sha256").distinct(), "raise") for kept, recipes in parts]
    whole = reduce(DataFrame.unionByName, chunks).groupBy("sha256").agg(F.max("data").alias("data"))
    recipes = reduce(DataFrame.unionByName, [r for _, r in parts])
    return store.restore(recipes, whole).select("file_id", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def q_store_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under its key, after those with even ids were put anew with an `x` before them."""
    kept, keys = _fixed_store(spark, sf_dir)
    kept = settle(kept, "store")
    new = documents(spark, sf_dir).where("item_id % 2 = 0").select(F.sha2("content", 256).alias("sha256"), F.concat(F.lit(b"x"), "content").alias("data"))
    found = store.get(settle(store.put(kept, new), "store"), keys, "raise")
    return found.select("sha256", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("held_sha256"))


def q_store_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are missing from a cleared store: all of them."""
    kept, keys = _fixed_store(spark, sf_dir)
    return store.missing(store.clear(kept), keys)


def q_stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents from a store and recipes that were written to a folder and read from there."""
    path = shared_path(spark, "stored")
    plan = SimilarityPipeline(sizes=CHUNKS, hasher="sampled", clusterer="equal", codec="block", compress=True)
    write_store(*plan.scrub(files(spark, sf_dir)), path)
    kept, recipes = read_store(spark, path)
    return plan.read(kept, recipes).select("file_id", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def q_file_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's own files as bytes: read, chunked, and joined again."""
    read = read_files(spark, f"{sf_dir}/pages.parquet", "*.parquet").select(F.regexp_extract("file_id", "[^/]+$", 0).alias("file_id"), "content")
    chunks = settle(chunking.content_chunks(read, kind="string"), "chunks")
    whole = store.restore(chunks.select("file_id", "seq", "sha256"), chunks.select("sha256", "data").dropDuplicates(["sha256"]))
    return whole.join(read.select("file_id", F.sha2("content", 256).alias("before")), "file_id").select("file_id", F.octet_length("content").cast("long").alias("n_bytes"), (F.sha2("content", 256) == F.col("before")).alias("same"))


def q_scrub_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a scrub whose chunks are whole documents; the store is no larger than they are, and stages take time."""
    plan = SimilarityPipeline(sizes=(1 << 28, 1 << 29, 1 << 30))
    _, _, report = plan.scrub_report(files(spark, sf_dir))
    return report.select("total_points", "clusters", "raw_bytes", (F.col("data_left") + F.col("processed_data") <= F.col("raw_bytes")).alias("not_larger"), ((F.col("hashing_s") > 0) & (F.col("clustering_s") > 0) & (F.col("encoding_s") > 0)).alias("timed"))


def q_cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(cluster.with_parents(clusters(spark, sf_dir)))


def q_store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, keys = _fixed_store(spark, sf_dir)
    found = store.get(kept, keys)
    return found.select("sha256", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("restored_sha256"))


def _page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select(F.sha2("content", 256).alias("sha256"))


def q_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, keys = _fixed_store(spark, sf_dir)
    return store.contains(kept, keys.unionByName(_page_keys(spark, sf_dir)))


def q_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, keys = _fixed_store(spark, sf_dir)
    return store.missing(kept, keys.unionByName(_page_keys(spark, sf_dir)))


def q_free_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of raw chunks whose hashes collide, in order of arrival."""
    return store.place(points(spark, sf_dir).select("arrival", (F.col("sim_hash") % 97).alias("sim_hash")))


def q_incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of documents, the second of which repeats the first, in one store."""
    path = shared_path(spark, "ingest")
    docs = files(spark, sf_dir)
    add = add_batch(path, lambda f: chunking.content_chunks(f, *CHUNKS))
    add(docs.where("file_id % 2 = 0"), 0)
    add(docs, 1)
    chunks = spark.read.parquet(path)
    recipes = chunking.content_chunks(docs, *CHUNKS, bare=True).select("file_id", "seq", "sha256")
    whole = settle(store.restore(recipes, chunks).select("file_id", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256")), "ingested")
    forget(spark, path)
    return whole


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_restore_documents(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        q_scan_bytes, q_exact_dedup, q_fixed_chunks, q_gear_chunks, q_content_chunks, q_chunk_dedup_ratio, q_byte_hist, q_bigram_hist, q_spectral_hash_pages,
        q_neighbour_hash, q_sampled_sketch, q_sketch_neighbours, q_shingle_jaccard, q_eq_clusters, q_leader_clusters, q_incremental_clusters, q_islands, q_cluster_sizes, q_member_distances,
        q_leader_distances, q_cluster_totals, q_parent_pick, q_delta_ordinal, q_edit_distance, q_edit_gate, q_edit_script, q_delta_codes, q_delta_editscript, q_lz_flag_table, q_restore_documents, q_incremental_scrub, q_storage_report,
        q_total_dedup_ratio, q_cluster_dedup_ratio, q_store_lookup, q_contains, q_missing, q_free_cell, q_incremental_ingest,
        q_mixed_store, q_store_put, q_store_clear, q_stored_files, q_file_source, q_scrub_report, q_cluster_report,
    ]
    found = {f.__name__: f for f in named}
    found |= {"q_c_spectrum": _part("c_spectrum"), "q_f_spectrum": _part("f_spectrum"), "q_p_spectrum": _part("p_spectrum"), "q_spectral_hash": _part("sim_hash")}
    found |= {f"q_rt_{c}": _round_trip(c) for c in codecs.ENCODERS}
    found["q_rt_zstd"] = _round_trip("gearword", compress=True)
    return found


def _spectral_sql(items: str) -> str:
    """CTEs up to `spec` (item_id, c, f, p, h) for a query that gives item_id and content."""
    return f"""
        items as materialized ({items}),
        bytes as materialized (select item_id, pos, ('0x' || hx)::bigint as b from (select item_id, unnest(hx) as hx, generate_subscripts(hx, 1) as pos
            from (select item_id, regexp_extract_all(hex(content), '..') as hx from items))),
        hist as materialized (select item_id, b, count(*) as f from bytes group by all),
        rk as materialized (select item_id, b, f, row_number() over w - 1 as i, lead(f) over w as nf from hist window w as (partition by item_id order by f desc, b)),
        gaps as (select item_id, i, (f - nf) * (i + 1) as g from rk where nf >= 50 and (f - nf) * (i + 1) >= 1),
        ends as (select item_id, i, row_number() over (partition by item_id order by i) - 1 as k, coalesce(lag(i) over (partition by item_id order by i) + 1, 0) as s
            from (select *, row_number() over (partition by item_id order by g desc, i) as r from gaps) where r <= 8),
        blocks as (select e.item_id, e.k, bit_xor(rk.b) as x from ends e join rk on rk.item_id = e.item_id and rk.i between e.s and e.i group by all),
        c as (select item_id, bit_xor(x * (1::bigint << ((8 - k) * 3)::int)) as c from blocks group by 1),
        f as (select item_id, bit_xor((((f * 8) // (1::bigint << (length(bin(f * 8)) - 4)::int)) % 8) * (1::bigint << ([0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 6])[i + 1])) as f
            from rk where i < 16 group by 1),
        pairs as (select item_id, b1, b2, count(*) as n from (select item_id, b as b2, lag(b) over (partition by item_id order by pos) as b1 from bytes) where b1 is not null group by all),
        ranked as (select *, row_number() over (partition by item_id order by n desc, b1, b2) - 1 as i from pairs),
        p as (select item_id, bit_xor(xor((((b1 * 8) % 256) + b1 // 32) * 16, ((b2 % 8) * 32) + b2 // 8) * 1048576) as p from ranked where i between 5 and 8 group by 1),
        spec as materialized (select item_id, coalesce(c, 0) as c, coalesce(f, 0) as f, coalesce(p, 0) as p, xor(xor(coalesce(c, 0), coalesce(f, 0)), coalesce(p, 0)) as h
            from items left join c using (item_id) left join f using (item_id) left join p using (item_id))"""


_DOCS = "select doc_id as item_id, encode(text) as content from documents"
_TEXT = "select doc_id as {key}, strlen(text)::bigint as n_bytes, sha256(text) as sha256 from documents"
_POINTS = _spectral_sql(_DOCS) + """,
        points as materialized (select sha256(d.text) as sha256, min(d.doc_id) as arrival, min(spec.h) as sim_hash from documents d join spec on spec.item_id = d.doc_id group by 1)"""
#: The fold over arrivals, one at a time.
_FOLD = _POINTS + f""",
        seq as materialized (select row_number() over (order by {{order}}) as rn, arrival, sim_hash as h, sha256 from points),
        fold as (select 0::bigint as rn, 0::bigint as root, []::bigint[] as roots
            union all select rn, root, case when list_contains(roots, root) then roots else list_append(roots, root) end from (
                select s.rn, fold.roots, coalesce(list_min(list_transform(list_filter(fold.roots, lambda x: abs(x - s.h) <= {cluster.RADIUS}), lambda x: {{{{'d': abs(x - s.h), 'x': x}}}})).x, s.h) as root
                from fold join seq s on s.rn = fold.rn + 1)),
        clustered as materialized (select s.sha256, s.arrival, s.h as sim_hash, fold.root as cluster_id from seq s join fold using (rn))"""
_LEADERS = _FOLD.format(order="arrival")


def _fixed_sql(select: str) -> str:
    width = 2 * FIXED
    return f"""
        with parts as (select doc_id as file_id, regexp_extract_all(hex(encode(text)), '.{{1,{width}}}') as hx from documents),
        chunks as (select file_id, unnest(hx) as h, generate_subscripts(hx, 1) - 1 as seq from parts),
        cut as (select file_id, seq::bigint as seq, (seq * {FIXED})::bigint as "offset", (length(h) // 2)::bigint as length, sha256(unhex(h)) as sha256 from chunks)
        {select}"""


def _rolling_sql(width: int) -> str:
    """CTEs up to `fp` (item_id, pos from 0, b, v): the gear sum over the last `width` bytes, mod 2^width."""
    terms = " + ".join(f"coalesce(lag(g, {j}) over w, 0) * {1 << j} % {1 << width}" for j in range(width))
    return f"""
        bytes as (select item_id, pos - 1 as pos, ('0x' || hx)::bigint as b from (select doc_id as item_id, unnest(hx) as hx, generate_subscripts(hx, 1) as pos
            from (select doc_id, regexp_extract_all(hex(encode(text)), '..') as hx from documents))),
        gear as (select b, ('0x' || substr(sha256(b::varchar), 9, 8))::bigint as g from range(256) t(b)),
        fp as materialized (select item_id, pos, b, ({terms}) % {1 << width} as v from (select * from bytes join gear using (b)) window w as (partition by item_id order by pos))"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "q_scan_bytes": """
            select 'documents' as origin, doc_id as item_id, strlen(text)::bigint as n_bytes, sha256(text) as sha256 from documents
            union all select 'pages', page_id, strlen(html)::bigint, sha256(html) from pages""",
        "q_exact_dedup": _fixed_sql("select sha256, length, count(*) as copies, min({'f': file_id, 's': seq}).f as first_file, min({'f': file_id, 's': seq}).s as first_seq from cut group by sha256, length"),
        "q_fixed_chunks": _fixed_sql('select file_id, seq, "offset", length, sha256 from cut'),
        "q_gear_chunks": f"""
            with {_rolling_sql(GEAR_BITS)},
            starts as (select item_id, pos from fp where pos > 0 and v = {1 << GEAR_BITS - 1} union all select doc_id, 0 from documents where strlen(text) > 0)
            select item_id as file_id, row_number() over w - 1 as seq, pos::bigint as "offset", (coalesce(lead(pos) over w, strlen(text)) - pos)::bigint as length
            from starts join documents on doc_id = item_id window w as (partition by item_id order by pos)""",
        "q_content_chunks": _TEXT.format(key="file_id"),
        "q_chunk_dedup_ratio": _fixed_sql("""select sum(length * copies)::bigint as logical_bytes, sum(length)::bigint as unique_bytes, round(sum(length * copies) / sum(length), 6) as ratio
            from (select sha256, length, count(*) as copies from cut group by all)"""),
        "q_byte_hist": f"with {_spectral_sql(_DOCS)} select item_id, b as value, f as n from hist",
        "q_bigram_hist": f"with {_spectral_sql(_DOCS)} select item_id, b1 * 256 + b2 as value, n from pairs",
        "q_c_spectrum": f"with {_spectral_sql(_DOCS)} select item_id, c as c_spectrum from spec",
        "q_f_spectrum": f"with {_spectral_sql(_DOCS)} select item_id, f as f_spectrum from spec",
        "q_p_spectrum": f"with {_spectral_sql(_DOCS)} select item_id, p as p_spectrum from spec",
        "q_spectral_hash": f"with {_spectral_sql(_DOCS)} select item_id, h as sim_hash from spec",
        "q_spectral_hash_pages": f"with {_spectral_sql('select page_id as item_id, encode(html) as content from pages')} select item_id, h as sim_hash from spec",
        "q_neighbour_hash": f"with {_spectral_sql(_DOCS)} select item_id, least(h + 1, 4294967295) as next_hash, greatest(h - 1, 0) as last_hash from spec",
        "q_eq_clusters": f"with {_POINTS} select sim_hash as cluster_id, count(*) as members from points group by 1",
        "q_leader_clusters": f"with recursive {_LEADERS} select arrival, sim_hash, cluster_id from clustered",
        "q_incremental_clusters": f"with recursive {_FOLD.format(order='arrival % 2, arrival')} select arrival, sim_hash, cluster_id from clustered",
        "q_islands": f"""with {_POINTS}, keys as (select distinct sim_hash as key from points),
            marked as (select key, case when coalesce(key - lag(key) over (order by key) <= {cluster.RADIUS}, false) then null else key end as start from keys)
            select key, max(start) over (order by key rows unbounded preceding) as island from marked""",
        "q_cluster_sizes": f"with recursive {_LEADERS} select cluster_id, count(*) as members from clustered group by 1",
        "q_member_distances": f"""with recursive {_LEADERS} select cluster_id, arrival, abs(sim_hash - cluster_id) as distance
            from (select *, row_number() over (partition by cluster_id order by arrival) as nth from clustered) where nth > 1""",
        "q_leader_distances": f"""with recursive {_LEADERS}, l as (select distinct cluster_id from clustered)
            select a.cluster_id, b.cluster_id as other_id, abs(a.cluster_id - b.cluster_id) as distance from l a join l b on a.cluster_id <> b.cluster_id""",
        "q_cluster_totals": f"with recursive {_LEADERS} select count(*) as total_points, count(distinct cluster_id) as clusters from clustered",
        "q_parent_pick": f"""with recursive {_LEADERS} select arrival, cluster_id, row_number() over w = 1 as is_parent, first(sha256) over w as parent_sha256
            from clustered window w as (partition by cluster_id order by arrival)""",
        "q_delta_ordinal": f"""with {_POINTS}, few as (select arrival, sim_hash % 64 as sim_hash from points)
            select arrival, sim_hash, row_number() over (partition by sim_hash order by arrival) - 2 as ordinal from few qualify row_number() over (partition by sim_hash order by arrival) > 1""",
        "q_edit_distance": """
            select a.conv_id, a.turn, levenshtein(a.text, b.text)::bigint as distance from conversations a
            join conversations b on a.conv_id = b.conv_id and a.turn = b.turn + 1""",
        "q_edit_gate": f"""
            select a.conv_id, a.turn, abs(strlen(a.text) - strlen(b.text)) <= {codecs.MOST_DIFFERENCE} and 4 * levenshtein(a.text, b.text) + 4 <= strlen(a.text) as worth from conversations a
            join conversations b on a.conv_id = b.conv_id and a.turn = b.turn + 1""",
        "q_edit_script": f"""
            with d as (select a.conv_id, a.turn, strlen(a.text) as n, abs(strlen(a.text) - strlen(b.text)) <= {codecs.MOST_DIFFERENCE} as near, levenshtein(a.text, b.text)::bigint as d
                from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = b.turn + 1)
            select conv_id, turn, case when near and 4 * d + 4 <= n then 'delta' else 'simple' end as kind, case when near and 4 * d + 4 <= n then d else 0 end as steps from d""",
        "q_delta_codes": f"""
            with whole as (select doc_id // {BUNDLE} as item_id, string_agg(hex(encode(text)), '' order by doc_id) as h from documents where text is not null group by 1),
            cut as (select item_id, h, length(h) // 2 as n, length(h) // 8 as q, length(h) // 4 as m, length(h) // 20 as t from whole where length(h) >= 80),
            child as (select unhex(substr(h, 2 * (n - t) + 1) || substr(h, 1, 2 * q) || '2B' || substr(h, 2 * q + 1, 2 * (m - q)) || '23' || substr(h, 2 * m + 3)) as c from cut)
            select codec, count(*) as pairs, sum(octet_length(c))::bigint as raw_bytes, bit_xor(('0x' || substr(sha256(c), 1, 15))::bigint) as restored, true as mostly_deltas, true as deltas_copy, true as shorter, true as halved
            from child cross join (select unnest(['gearword', 'subchunk', 'subchunk_speed', 'subchunk_compression', 'block', 'lz_raw', 'lz']) as codec) group by codec""",
        "q_delta_editscript": """
            with d as (select doc_id as item_id, hex(encode(text)) as h, strlen(text) as n from documents where strlen(text) >= 4),
            c as (select item_id, n, unhex('01' || substr(h, 3, 2 * (n // 2 - 1)) || substr(h, 2 * (n // 2) + 3) || '02') as child from d)
            select item_id, case when n >= 16 then 'delta' else 'simple' end as kind, case when n >= 16 then 12 else n end::bigint as payload_bytes, case when n >= 16 then 3 else 0 end::bigint as steps, sha256(child) as sha256 from c""",
        "q_mixed_store": _TEXT.format(key="file_id"),
        "q_stored_files": _TEXT.format(key="file_id"),
        "q_store_put": """select sha256(text) as sha256, max(strlen(text))::bigint + max(case when doc_id % 2 = 0 then 1 else 0 end) as n_bytes,
            case when max(case when doc_id % 2 = 0 then 1 else 0 end) = 1 then sha256('x' || any_value(text)) else sha256(any_value(text)) end as held_sha256 from documents group by 1""",
        "q_store_clear": "select distinct sha256(text) as sha256 from documents",
        "q_scrub_report": f"""with recursive {_LEADERS}, whole as (select distinct text from documents where strlen(text) > 0)
            select count(*) as total_points, count(distinct cluster_id) as clusters, (select sum(strlen(text))::bigint from whole) as raw_bytes, true as not_larger, true as timed
            from clustered where sha256 <> sha256('')""",
        "q_cluster_report": f"""with recursive {_LEADERS}, nth as (select *, row_number() over (partition by cluster_id order by arrival) as nth from clustered)
            select cluster_id, count(*) as members, sum(case when nth > 1 then abs(sim_hash - cluster_id) end)::bigint as total_distance, max(case when nth > 1 then abs(sim_hash - cluster_id) end) as largest_distance from nth group by 1""",
        "q_lz_flag_table": """
            select size, kind, 1 + 5 * ((size - 3) // 256) + kind as flag, (size - 3) % 256 as rest, size as size_again, kind as kind_again
            from range(3, 1027) a(size) cross join range(5) b(kind)""",
        "q_restore_documents": _TEXT.format(key="file_id"),
        "q_incremental_scrub": _TEXT.format(key="file_id"),
        "q_store_lookup": "select distinct sha256(text) as sha256, strlen(text)::bigint as n_bytes, sha256(text) as restored_sha256 from documents",
        "q_contains": "select distinct sha256(text) as sha256 from documents",
        "q_missing": "select sha256(html) as sha256 from pages where sha256(html) not in (select sha256(text) from documents)",
        "q_free_cell": f"""with recursive {_POINTS}, seq as (select row_number() over (order by arrival) as rn, arrival, sim_hash % 97 as h from points),
            probe as (select 0::bigint as rn, 0::bigint as cell, repeat('0', (select count(*) from points)::bigint + 98) as taken
                union all select rn, cell, substr(taken, 1, cell) || '1' || substr(taken, cell + 2) from (
                    select rn, case when down >= 0 and h - down < up - h then down else up end as cell, taken from (
                        select s.rn, s.h, probe.taken, s.h + instr(substr(probe.taken, s.h + 1), '0') - 1 as up,
                            case when contains(substr(probe.taken, 1, s.h + 1), '0') then s.h - instr(reverse(substr(probe.taken, 1, s.h + 1)), '0') + 1 else -1 end as down
                        from probe join seq s on s.rn = probe.rn + 1)))
            select arrival, h as sim_hash, cell from seq join probe using (rn)""",
        "q_incremental_ingest": _TEXT.format(key="file_id"),
        "q_rt_zstd": _TEXT.format(key="item_id"),
    }
    sql |= {f"q_rt_{c}": _TEXT.format(key="item_id") for c in codecs.ENCODERS}
    low = [c & 0xFFFFFFFF for c in sampled.FACTORS]
    features = ", ".join(f"min((({c}::hugeint * v + b) % 4294967296)::bigint) filter (v % {1 << SKETCH_BITS} = 0) as feature_{k}" for k, c in enumerate(low))
    sketch = f"with {_rolling_sql(32)} , found as (select doc_id as item_id, feature_0, feature_1, feature_2 from documents left join (select item_id, {features} from fp group by 1) on item_id = doc_id)"
    sql["q_sampled_sketch"] = f"{sketch} select item_id, coalesce(feature_0, -1) as feature_0, coalesce(feature_1, -1) as feature_1, coalesce(feature_2, -1) as feature_2 from found"
    low = "case when feature_2 % 2 = 0 then 0 else feature_2 end"
    sql["q_sketch_neighbours"] = f"""{sketch}, low as (select item_id, feature_0 as a, feature_1 as b, {low} as c from found where feature_2 is not null)
        select item_id, a as next_0, b as next_1, c + 1 as next_2, case when b = 0 and c = 0 then a - 1 else a end as last_0,
            case when c = 0 then b - 1 else b end as last_1, c - 1 as last_2 from low"""
    step = shingle.WORD * shingle.WORDS
    sql["q_shingle_jaccard"] = f"""
        with t as (select doc_id, hex(encode(text)) as h, strlen(text) as n from documents),
        s as materialized (select doc_id, list_distinct(list_transform(range(0, greatest(n - {step}, 0) + 1, {shingle.WORD}), lambda i: substr(h, 2 * i + 1, {2 * step}))) as own from t where n > 0)
        select a.doc_id as item_id, len(list_intersect(a.own, b.own))::bigint as common, (len(a.own) + len(b.own) - len(list_intersect(a.own, b.own)))::bigint as united
        from s a join s b on a.doc_id = b.doc_id + 1"""
    return sql
