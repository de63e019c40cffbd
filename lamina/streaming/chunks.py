"""Extension: a stream of Parquet files is encoded in chunks, each batch's once and for all.

The reference data model has no streams; this applies the integer codec to
chunks as they arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encode import compressed, encoded_size
from ..operators.stripe import at_most_one_block


def encoded_chunks(df: DataFrame, pos: str, col: str, size: int = 1000) -> DataFrame:
    """(chunk, n, data, n_bytes): the codec's bytes of each chunk of ``size`` positions; a chunk bounds what one task gathers."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(col).cast("long").alias("x")))), lambda e: e["x"])
    chunks = df.groupBy(at_most_one_block(pos, size).alias("chunk")).agg(F.count("*").alias("n"), ordered.alias("xs"))
    coded = chunks.select("chunk", "n", compressed("xs").alias("data"))
    return coded.withColumn("n_bytes", F.octet_length("data").cast("long"))


def stream_chunks(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, pos: str, col: str, size: int = 1000):
    """Encode all files that are there and stop; a batch that is repeated overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        encoded_chunks(batch, pos, col, size).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["encoded_chunks", "encoded_size", "stream_chunks"]
