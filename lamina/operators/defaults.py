"""Default values and empty tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Schema, member, row_type, spark_type


def default_value(schema: Schema) -> Column:
    """Zero, empty, a struct of defaults, an enum's first variant; an empty enum has none."""
    kind = schema.kind
    if kind == "int":
        return F.lit(0).cast("long")
    if kind == "double":
        return F.lit(0.0)
    if kind == "binary":
        return F.lit("").cast(spark_type(schema))
    if kind == "struct":
        return F.struct(*[default_value(s).alias(n) for n, s in schema.parts])
    if kind == "enum" and schema.parts:
        first = schema.parts[0]
        return F.struct(F.lit(first[1]).cast("long").alias("tag"), *[(default_value(s) if t == first[1] else F.lit(None).cast(spark_type(s))).alias(member(t)) for _, t, s in schema.parts])
    if kind == "reversed":
        return default_value(schema.inner)
    if kind == "nested" and schema.inner.kind == "binary":
        return default_value(schema.inner)
    return F.array().cast(spark_type(schema)) if kind in ("array", "nested") else F.lit(None)


def fill(df: DataFrame, schema: Schema) -> DataFrame:
    """A struct schema's columns with nulls, and columns that are missing, set to defaults."""
    return df.select(*[(F.coalesce(F.col(f"`{n}`"), default_value(s)) if n in df.columns else default_value(s)).alias(n) for n, s in schema.parts])


def default_table(spark: SparkSession, table: Schema) -> DataFrame:
    return spark.createDataFrame([], row_type(table))
