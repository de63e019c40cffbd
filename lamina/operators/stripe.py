"""Striping: nested rows become leaf columns, and leaf columns become rows again.

Order is carried in ``_pos`` columns.  Leaves of a column type are DataFrames:
a scalar is (_pos, value), bytes and arrays are lengths and a flat column, a
struct is a column for each field, an enum its tags and a dense column for each
tag, a nested table its lengths and rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..schema import Schema, member, spark_type
from .validate import check_shape


def lengths(df: DataFrame, col: str, pos: str = "_pos") -> DataFrame:
    """(pos, length) of an array column."""
    return df.select(pos, F.size(col).cast("long").alias("length"))


def byte_lengths(df: DataFrame, col: str, pos: str = "_pos") -> DataFrame:
    return df.select(pos, F.octet_length(col).cast("long").alias("length"))


def elements(df: DataFrame, col: str, pos: str = "_pos") -> DataFrame:
    """(pos, _at, value): the elements of an array column in their places."""
    return df.select(pos, F.posexplode(col).alias("_at", "value")).withColumn("_at", F.col("_at").cast("long"))


def struct_columns(df: DataFrame, col: str, schema: Schema, pos: str = "_pos") -> DataFrame:
    """A column for each field of the schema, by name and in its order; other fields are left out."""
    if not schema.parts:
        raise SchemaError.unsupported("Empty struct schemas are not supported")
    there = df.schema[col].dataType.names
    for name, _ in schema.parts:
        if name not in there:
            raise SchemaError.missing(name)
    return df.select(pos, *[F.col(f"{col}.`{n}`").alias(n) for n, _ in schema.parts])


def dense(df: DataFrame, tag: str = "tag", pos: str = "_pos", block: str | None = None) -> DataFrame:
    """``_nth``: the rank of each row among those of its tag (in its block), in the order of ``pos``."""
    keys = [tag, *([block] if block else [])]
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(pos)).cast("long"))


def enum_columns(df: DataFrame, col: str, schema: Schema, pos: str = "_pos", block: str | None = None) -> tuple[DataFrame, dict[int, DataFrame]]:
    """The tags (pos, tag, _nth) and for each tag its dense column (_nth, value)."""
    own = [block] if block else []
    ranked = dense(df.select(pos, *own, F.col(f"{col}.tag").alias("tag"), col), "tag", pos, block)
    parts = {t: ranked.where(F.col("tag") == t).select(*own, "_nth", F.col(f"{col}.{member(t)}").alias("value")) for _, t, s in schema.parts}
    return ranked.select(pos, *own, "tag", "_nth"), parts


def enum_rows(tags: DataFrame, parts: dict[int, DataFrame], schema: Schema, col: str, pos: str = "_pos", block: str | None = None) -> DataFrame:
    """Rows (pos, col) from tags and dense columns; each value goes back to the row with its rank.

    All dense columns meet the tags in one join; a tag without its value, or a
    value without its tag, is an error.
    """
    own = [block] if block else []
    keys = [*own, "_nth", "tag"]
    stored = [(t, spark_type(s)) for _, t, s in schema.parts]
    every = None
    for t, _ in stored:
        members = [(F.col("value") if t == u else F.lit(None)).cast(kind).alias(member(u)) for u, kind in stored]
        one = parts[t].select(*own, "_nth", F.lit(t).cast("long").alias("tag"), *members, F.lit(True).alias("_stored"))
        every = one if every is None else every.unionByName(one)
    whole = F.when(F.col(pos).isNotNull() & F.col("_stored"), F.struct("tag", *[member(t) for t, _ in stored]))
    lost = F.raise_error(F.lit("Vector operation failed: enum variant length mismatch")).cast(whole_type(stored))
    joined = tags.select(pos, *keys).join(every, keys, "full")
    return joined.select(pos, *own, F.coalesce(whole, lost).alias(col))


def whole_type(stored: list[tuple[int, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField("tag", T.LongType()), *(T.StructField(member(t), kind) for t, kind in stored)])


def array_rows(sizes: DataFrame, flat: DataFrame, col: str, pos: str = "_pos") -> DataFrame:
    """Rows (pos, col) from (pos, length) and (pos, _at, value); empty arrays come back, and lengths are checked."""
    grouped = flat.groupBy(pos).agg(F.array_sort(F.collect_list(F.struct("_at", "value"))).alias("_parts"))
    element = flat.schema["value"].dataType.simpleString()
    joined = sizes.join(grouped, pos, "left")
    values = F.coalesce(F.transform("_parts", lambda x: x["value"]), F.array().cast(f"array<{element}>"))
    right = F.size(values) == F.col("length")
    return joined.select(pos, F.when(right, values).otherwise(F.raise_error(F.lit("Vector operation failed: array length mismatch")).cast(f"array<{element}>")).alias(col))


def offsets(df: DataFrame, length: str = "length", pos: str = "_pos", block: str | None = None) -> DataFrame:
    """``_offset``: the sum of the lengths before, in each block, or in the whole table.

    Without blocks rows are dealt by ranges of ``pos``; running totals of the few
    ranges are added to the sums inside them, so no task sees the whole table.
    """
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if block:
        return df.withColumn("_offset", F.coalesce(F.sum(length).over(before([block], pos)), F.lit(0)).cast("long"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The values of pos at which ranges begin, from the data; a row's range depends on its pos alone.
    cuts = sorted(set(df.approxQuantile(pos, [i / parts for i in range(1, parts)], 0.25 / parts)))
    part = F.lit(0) if not cuts else F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, c: n + (F.col(pos) >= c).cast("int"))
    dealt = df.withColumn("_part", part)
    totals = dealt.groupBy("_part").agg(F.sum(length).alias("_total"))
    starts = totals.select("_part", F.coalesce(F.sum("_total").over(before([], "_part")), F.lit(0)).alias("_start"))  # a row for each range
    inside = dealt.withColumn("_offset", F.coalesce(F.sum(length).over(before(["_part"], pos)), F.lit(0)))
    return inside.join(F.broadcast(starts), "_part").withColumn("_offset", (F.col("_offset") + F.col("_start")).cast("long")).select(*df.columns, "_offset")


def blobs(df: DataFrame, col: str, block: str, pos: str = "_pos") -> DataFrame:
    """(block, data): the bytes of a block joined in order; blocks bound what one task gathers."""
    text = F.array_sort(F.collect_list(F.struct(F.col(pos), F.hex(F.col(col).cast("binary")).alias("x"))))
    return df.groupBy(block).agg(F.unhex(F.concat_ws("", F.transform(text, lambda e: e["x"]))).alias("data"))


def bytes_rows(sizes: DataFrame, data: DataFrame, col: str, block: str, pos: str = "_pos") -> DataFrame:
    """Rows (pos, col) from (block, pos, length) and (block, data); the lengths must use up the data."""
    placed = offsets(sizes, "length", pos, block)
    total = sizes.groupBy(block).agg(F.sum("length").alias("_total"))
    joined = placed.join(data.join(total, block), block)
    cut = F.substring("data", F.col("_offset") + 1, F.col("length"))
    fine = F.octet_length("data") == F.col("_total")
    return joined.select(pos, F.when(fine, cut).otherwise(F.raise_error(F.lit("Vector operation failed: binary length mismatch")).cast("binary")).alias(col))


def map_rows(keys: DataFrame, values: DataFrame, pos: str = "_pos") -> DataFrame:
    """(pos, key, value) from two columns (pos, value), joined by position; a position that only one of them has is an error."""
    one = keys.select(pos, F.col("value").alias("key"), F.lit(True).alias("_k"))
    two = values.select(pos, "value", F.lit(True).alias("_v"))
    text = F.concat(F.lit("Column count mismatch: position "), F.col(pos).cast("string"), F.when(F.col("_k").isNull(), " has no key").otherwise(" has no value"))
    fine = F.when(F.col("_k") & F.col("_v"), True).otherwise(F.raise_error(text).cast("boolean"))
    return one.join(two, pos, "full").where(fine).select(pos, "key", "value")


def scalars(df: DataFrame, col: str, schema: Schema, pos: str = "_pos") -> DataFrame:
    """(pos, value) of an int or double column; another type is an error."""
    check_shape(schema, df.schema[col].dataType)
    return df.select(pos, F.col(f"`{col}`").cast(spark_type(schema)).alias("value"))


def row_count(df: DataFrame, table: Schema) -> DataFrame:
    """One row (n): of an array its rows, of a map its keys, of a binary table 1 if it has bytes."""
    return df.agg((F.count_if(F.octet_length("data") > 0) if table.kind == "binary" else F.count("key") if table.kind == "map" else F.count("*")).alias("n"))


def at_most_one_block(col: str | Column, size: int = 1000) -> Column:
    """The block of a row number: blocks of ``size`` rows."""
    x = F.col(col) if isinstance(col, str) else col
    return F.call_function("div", x - F.pmod(x, F.lit(size)), F.lit(size)).cast("long")
