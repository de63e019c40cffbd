"""Contiguous shards of near-equal bytes, from DataFrame functions alone.

Rows are sorted by doc_id into range partitions, each partition's bytes and
rows are totalled, and the running totals of those few partitions turn a
partition-local prefix sum into a global one.  A row belongs to the shard in
which the middle of its byte span falls, so a shard misses its target by at
most one document.

Defined results: a null text has size 1 and a null checksum; null doc_ids come
first; equal doc_ids are ordered by text checksum and then as read; an empty
table gives an empty result; other columns are ignored; the size of one text
bounds nothing, texts never leave the scan stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, table


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): ``shards`` contiguous ranges of near-equal bytes."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("seen"),
    )
    order = ["doc_id", "text_crc32", "seen"]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = Written(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "shard-rows").df
    # One row for each range partition, however many documents there are.
    per_part = dealt.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = Written(
        per_part.select(
            "part",
            F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("part_bytes").over(whole).alias("all_bytes"),
        ),
        "shard-totals",
    ).df
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select("*", F.sum("size").over(inside).alias("upto"), F.row_number().over(inside).alias("nth"))
    placed = local.join(F.broadcast(starts), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        # Twice the middle of the row's byte span, times the shards, over twice all bytes.
        F.least(F.lit(shards - 1), F.expr(f"cast((2 * (bytes_before + upto) - size) * cast({shards} as decimal(20,0)) div (2 * all_bytes) as int)")).alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("nth"),
    )
    cut = Written(placed, "shard-placed").df
    first = cut.groupBy("shard").agg(F.min("nth").alias("first"))  # a row for each shard
    return cut.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``bytes``."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
