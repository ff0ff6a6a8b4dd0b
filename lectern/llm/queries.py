"""Registered queries of the subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import ready, table

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_crf import judge_documents

    return judge_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls, rule_table

    pages = table(spark, sf_dir, "pages")
    return judge_urls(spark, pages, rule_table(spark, RULES)).drop("url")


def op3_simhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_forest import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op4_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import round_trip

    return round_trip(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), kind="word", end_id=1, added=True)


def op5_blockmax_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contaminated

    return find_contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import removed_bytes

    return removed_bytes(spark, table(spark, sf_dir, "documents"))


def op7_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ring import shard_documents

    return shard_documents(ready(spark), table(spark, sf_dir, "documents"), n_shards=24)


def op8_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024, added=True)


def op9_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .unigram_count import count_tokens

    return count_tokens(spark, table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(spark, table(spark, sf_dir, "pages"), least=0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_crf_quality": op1_crf_quality,
    "op2_url_filter": op2_url_filter,
    "op3_simhash_forest": op3_simhash_forest,
    "op4_plane_tokens": op4_plane_tokens,
    "op5_blockmax_decontamination": op5_blockmax_decontamination,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_hash_ring": op7_hash_ring,
    "op8_certified_packing": op8_certified_packing,
    "op9_trie_token_counts": op9_trie_token_counts,
    "op10_warc_segments": op10_warc_segments,
}

def _url_sql() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda f: " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{f(h, p, v)}'" for h, p, v in ordered)
    return f"""
    with cut as (
      select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
      from pages)
    select page_id, host, path, case {case(lambda h, p, v: h + p)} else null end as rule,
           case {case(lambda h, p, v: v)} else 'allow' end as verdict
    from cut"""


#: Five hex digits of a SHA-1 at a time are four base-32 letters.
_WARC_SQL = """
with p as (select page_id, coalesce(html, '') html from pages),
d as (select page_id, octet_length(encode(html))::bigint payload_bytes, sha1(html) h from p),
b as (select page_id, payload_bytes, h, array_to_string(list_transform(range(8), lambda i:
        array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * i::int + 1, 5))::int >> k) & 31), 1)), '')), '') payload_digest,
      max(page_id) over (partition by h) top from d)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end record_type,
       case when page_id = top then null else top end refers_to from b"""

SQL: dict[str, str] = {"op2_url_filter": _url_sql(), "op10_warc_segments": _WARC_SQL}
