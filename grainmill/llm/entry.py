"""Queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from grainmill.llm import urlfilter
from grainmill.llm.bpe import encode_digests
from grainmill.llm.exactdedup import exact_duplicates
from grainmill.llm.minhash import near_duplicates
from grainmill.llm.mixing import draws
from grainmill.llm.pii import pseudonyms
from grainmill.llm.quality import quality_scores
from grainmill.llm.tokencount import token_counts
from grainmill.llm.topk import top_k
from grainmill.llm.warc import archive_round_trip

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "n_shards")


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(_table(spark, sf_dir, "documents"), TOKENIZER)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the key in the session's setting; the synthetic tables have one of their own, which is no secret."""
    return pseudonyms(_table(spark, sf_dir, "documents"), spark.conf.get("spark.grainmill.pseudonymKey", "key of the synthetic tables").encode())


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), TOKENIZER)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mix_sources, op2_warc_round_trip, op3_minhash_dedup, op4_bpe_round_trip, op5_exact_top_k, op6_quality, op7_pseudonyms, op8_token_counts, op9_url_filter, op10_exact_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_round_trip": """
            with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
            r as (select page_id, octet_length(payload) as n, sha1(payload) as h, max(page_id) over (partition by payload) as newest from p)
            select page_id, n::bigint as payload_bytes,
                array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, 5 * (i // 4) + 1, 5))::bigint // (1 << (15 - 5 * (i % 4))::int)) % 32, 1)), '') as payload_digest,
                case when page_id is not distinct from newest then 'response' else 'revisit' end as record_type, case when page_id is distinct from newest then newest end as refers_to from r""",
        "op3_minhash_dedup": r"""
            with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
            own as materialized (select row_number() over () as n, doc_id, case when len(w) = 0 then [] else
                list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) end as shingles from t),
            each as materialized (select n, len(shingles) as size, unnest(shingles) as shingle from own),
            common as (select a.n as a, b.n as b, a.size + b.size as sizes, count(*) as c from each a join each b on a.shingle = b.shingle and a.n <> b.n group by all),
            links as materialized (select a, b from common where 100 * c >= 75 * (sizes - c)),
            reach as (select n, n as other from own union select reach.n, links.b from reach join links on links.a = reach.other),
            least as (select reach.n, min(own.doc_id) as component_id from reach join own on own.n = reach.other group by 1)
            select doc_id, len(shingles)::bigint as n_shingles, component_id, coalesce(doc_id = component_id, false) as kept from own join least using (n)""",
        "op5_exact_top_k": """
            with v as materialized (select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
                where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
            s as (select a.n, a.vec_id as query_id, b.vec_id, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0)::bigint as score
                from v a join v b on a.n <> b.n where a.vec_id % 50 = 0),
            r as (select query_id, row_number() over (partition by n order by score desc, vec_id nulls last)::int as rank, vec_id, score from s)
            select query_id, rank, vec_id, score from r where rank <= 5""",
        "op9_url_filter": urlfilter.oracle(),
        "op10_exact_dedup": r"""
            with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
            select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
                   doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
            from n""",
    }
