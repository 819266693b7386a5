"""Similarity deduplication end to end: chunk, dedup, hash, cluster, encode, restore, report."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions.sampled import with_sketch
from grainmill.functions.spectral import with_spectra
from grainmill.operators import chunking, cluster, codecs, store
from grainmill.operators.ranking import in_order
from grainmill.session import settle


#: By name: adds sim_hash to a column of bytes.
HASHERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "spectral": lambda rows: with_spectra(rows, "data"),
    "sampled": lambda rows: with_sketch(rows, "data").withColumn("sim_hash", F.xxhash64("features")),
}


@dataclass(frozen=True)
class SimilarityPipeline:
    """A choice of chunk sizes, hasher (spectral, sampled), clusterer (leader, equal) and codec.

    Sampled sketches are clustered by equality alone: they have no order in which near ones are alike.
    """

    sizes: tuple[int, int, int] = (chunking.MIN_SIZE, chunking.AVG_SIZE, chunking.MAX_SIZE)
    hasher: str = "spectral"
    clusterer: str = "leader"
    codec: str = "gearword"
    compress: bool = False
    radius: int = cluster.RADIUS

    def __post_init__(self):
        if self.hasher not in HASHERS or self.codec not in codecs.ENCODERS:
            raise ValueError(f"no such hasher or codec: {self.hasher}, {self.codec}")
        if self.hasher == "sampled" and self.clusterer != "equal":
            raise ValueError("sampled sketches need the equal clusterer")

    def chunk(self, files: DataFrame) -> DataFrame:
        return chunking.content_chunks(files, *self.sizes, bare=True)

    def unique(self, chunks: DataFrame) -> DataFrame:
        """sha256, data, arrival of the first copy of each chunk."""
        first = in_order(chunking.unique_chunks(chunks), ["first_file", "first_seq"], "arrival")
        return first.join(chunks, (first["first_file"] == chunks["file_id"]) & (first["first_seq"] == chunks["seq"])).select(first["sha256"], "data", "arrival", "copies", first["length"])

    def points(self, unique: DataFrame) -> DataFrame:
        """sha256, arrival, sim_hash of unique chunks; of a chunk without a sampled byte the hash is that of its digest."""
        hashed = HASHERS[self.hasher](unique.select("sha256", "arrival", "data"))
        return hashed.select("sha256", "arrival", F.coalesce("sim_hash", F.xxhash64("sha256")).alias("sim_hash"))

    def members(self, points: DataFrame, held: DataFrame | None = None) -> DataFrame:
        known = cluster.parents_of(held) if held is not None and self.clusterer == "leader" else None
        return cluster.with_parents(settle(cluster.cluster_points(points, self.clusterer, self.radius, known), "clusters"), held)

    def scrub(self, files: DataFrame, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(store, recipes) of files (file_id, content).

        held: the store of earlier scrubs by the same plan, a table that can be read again. Its chunks stay as they are, its
        parents lead, and the result holds it and what is new.
        """
        kept, recipes, _, _ = self._scrub(files, held)
        return kept, recipes

    def _scrub(self, files: DataFrame, held: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, float]]:
        took, began = {}, time.perf_counter()

        def done(stage: str) -> None:
            nonlocal began
            took[stage], began = time.perf_counter() - began, time.perf_counter()

        pieces = settle(self.chunk(files), "chunks")
        chunks = pieces.where("length > 0")
        unique = self.unique(chunks)
        unique = settle(unique if held is None else store.missing(held, unique), "unique")
        done("chunking")
        points = settle(self.points(unique), "points")
        done("hashing")
        members = settle(self.members(points, held), "members")
        done("clustering")
        kept = settle(store.build_store(unique.select("sha256", "data"), members, self.codec, self.compress, held), "store")
        done("encoding")
        return kept if held is None else held.unionByName(kept), pieces.select("file_id", "seq", "sha256"), members, took

    def scrub_report(self, files: DataFrame, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(store, recipes, report); report: one row of totals and of the seconds that each stage took."""
        kept, recipes, members, took = self._scrub(files, held)
        report = cluster.cluster_totals(members).join(storage_report(kept), F.lit(True))
        for stage, seconds in took.items():
            report = report.withColumn(f"{stage}_s", F.lit(seconds))
        return kept, recipes, report

    def read(self, kept: DataFrame, recipes: DataFrame) -> DataFrame:
        chunks = store.get(kept, recipes.where(~store.bare()).select("sha256").distinct(), "raise")
        return store.restore(recipes, chunks)


def cluster_report(members: DataFrame) -> DataFrame:
    """cluster_id, members, total_distance, largest_distance: chunks of each cluster, and how far all but the parent are from its key."""
    far = F.abs(F.col("sim_hash") - F.col("cluster_id"))
    return members.groupBy("cluster_id").agg(F.count("*").alias("members"), F.sum(F.when(~F.col("is_parent"), far)).alias("total_distance"), F.max(F.when(~F.col("is_parent"), far)).alias("largest_distance"))


def storage_report(kept: DataFrame) -> DataFrame:
    """data_left (bytes stored raw), processed_data (bytes of delta code), raw_bytes and chunks."""
    raw = F.col("kind") == "simple"
    size = F.octet_length("payload").cast("long")
    return kept.agg(F.coalesce(F.sum(F.when(raw, size)), F.lit(0)).alias("data_left"), F.coalesce(F.sum(F.when(~raw, size)), F.lit(0)).alias("processed_data"), F.sum("raw_length").alias("raw_bytes"), F.count("*").alias("chunks"))


def dedup_ratios(chunks: DataFrame) -> DataFrame:
    """Bytes of all chunks over bytes of distinct ones, rounded to 6 places."""
    distinct = chunks.groupBy("sha256", "length").agg(F.count("*").alias("copies"))
    logical, unique = F.sum(F.col("length") * F.col("copies")), F.sum("length")
    return distinct.agg(logical.alias("logical_bytes"), unique.alias("unique_bytes"), F.round(logical / unique, 6).alias("ratio"))
