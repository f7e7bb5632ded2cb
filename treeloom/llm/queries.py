"""The queries of this subpackage and, where SQL can say it, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, exact_dedup, langid, quality, sharding, simhash, suffix_dedup, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]
#: Bytes of a shard in the query that is to split.
SPLIT_BYTES = 64 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_histories(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def sharding_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of so few bytes that the directory splits many times at every scale."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SPLIT_BYTES)


def shard_sql(limit: int) -> str:
    return f"""
        with r as (select doc_id, octet_length(encode(coalesce(text, ''))) n, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 15) as bigint) h from documents),
        nodes as (select d, h >> (60 - d) p, sum(n) size, count(*) c, min(h) < max(h) apart from r, range(0, 61) t(d) group by 1, 2),
        leaf as (select r.doc_id, r.n, r.h, min(d) d from r, nodes where h >> (60 - d) = p and not (size > {limit} and c > 1 and apart) group by 1, 2, 3)
        select doc_id, case when leaf.d = 0 then '' else lpad(bin(p), cast(leaf.d as int), '0') end shard_id, cast(n as bigint) n_bytes, cast(size as bigint) shard_bytes, size > {limit} oversize
        from leaf join nodes on nodes.d = leaf.d and nodes.p = h >> (60 - leaf.d)
    """


QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_langid": op3_langid,
    "op4_quality": op4_quality,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_warc": op6_warc,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_bpe": op8_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_sharding": op10_sharding,
    "sharding_splits": sharding_splits,
}

ORACLES: dict[str, str] = {
    "op7_exact_dedup": """
        select doc_id,
               max(doc_id) over (partition by coalesce(text, '')) as keep_id,
               count(*) over (partition by coalesce(text, '')) as group_size,
               doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
               sha256(coalesce(text, '')) as text_sha256
        from documents
    """,
    "op1_decontaminate": r"""
        with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
        b as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
        bw as (select distinct item, k, list_slice(w, i, i + k - 1) g from (select item, w, k, unnest(range(1, len(w) - k + 2)) i from (select item, w, least(10, len(w)) k from b where len(w) > 0))),
        dw as (select doc_id, k, i, list_slice(w, i, i + k - 1) g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, (select distinct k from bw) where len(w) >= k)),
        found as (select doc_id, dw.k, i, item from dw join bw using (k, g)),
        hit as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + k)) p from found) group by 1),
        items as (select doc_id, count(*) n, string_agg(item, ',' order by item) names from (select distinct doc_id, item from found) group by 1)
        select d.doc_id, cast(len(w) as bigint) n_words, coalesce(hit.n, 0) n_hit, coalesce(items.n, 0) n_items, sha256(coalesce(names, '')) items_sha256, hit.n is not null contaminated
        from d left join hit using (doc_id) left join items using (doc_id)
    """,
    "op6_warc": r"""
        with p as (select page_id, coalesce(html, '') body, coalesce(url, 'about:blank') url from pages),
        q as (select page_id, octet_length(encode(body)) n, sha1(body) digest, regexp_replace(regexp_replace(url, '^.*?://', ''), '#.*$', '') rest,
            case when octet_length(encode(body)) >= 1000 then max(page_id) over (partition by body) end keep from p),
        u as (select *, lower(regexp_extract(rest, '^[^/?]*')) host, lower(regexp_extract(rest, '^[^/?]*(.*)$', 1)) path from q)
        select page_id, cast(n as bigint) payload_bytes, digest payload_digest, case when keep is null or keep = page_id then 'response' else 'revisit' end record_type,
            case when keep <> page_id then keep end refers_to,
            array_to_string(list_reverse(string_split(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':.*$', ''), '^www\.', ''), '.')), ',') || ')' || case when path = '' then '/' else path end url_key,
            946684800 + (page_id % 4294967296 + 4294967296) % 4294967296 captured_at
        from u
    """,
    "op10_sharding": shard_sql(sharding.SHARD_BYTES),
    "sharding_splits": shard_sql(SPLIT_BYTES),
}
