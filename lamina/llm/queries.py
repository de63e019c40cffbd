"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, langid, media, packing, sentencepieces, sharding, simhash, suffixes, tokencount, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_sharding": sharding.op2_sharding,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_token_counts": tokencount.op4_token_counts,
        "op5_packing": packing.op5_packing,
        "op6_language_id": langid.op6_language_id,
        "op7_sentencepiece": sentencepieces.op7_sentencepiece,
        "op8_suffix_dedup": suffixes.op8_suffix_dedup,
        "op9_media": media.op9_media,
        "op10_ann": ann.op10_ann,
    }


#: The checksum's table by its rule (reflected polynomial), then byte by byte.
_CRC32 = """
table_of as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n)) as t),
summed as (select doc_id, text, case when text is null then null else xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint)) end::bigint as text_crc32 from documents, table_of)"""

SHARDING = f"""with {_CRC32},
sized as (select doc_id, coalesce(octet_length(encode(text)), 0)::bigint + 1 as size, text_crc32 from summed),
upto as (select *, sum(size) over (order by doc_id, text_crc32 rows unbounded preceding) as upto, sum(size) over () as every from sized),
placed as (select doc_id, size, text_crc32, upto, least(7, (2 * upto - size) * 8 // (2 * every))::integer as shard from upto)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by upto) - 1 as slot, null::integer as grown_shard from placed"""


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": SHARDING}
