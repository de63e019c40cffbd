"""Validation: a schema becomes a boolean column, a report, or a strict plan that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..schema import DATE_LIMIT, Schema, member


def valid(schema: Schema, col: Column) -> Column:
    """Whether a value satisfies its schema; nulls do (the policy of a field is not consulted)."""
    kind = schema.kind
    if kind == "int" and schema.encoding == "date":
        return F.coalesce(col.between(0, DATE_LIMIT), F.lit(True))
    if kind == "binary" and schema.encoding == "utf8":
        return F.coalesce(F.is_valid_utf8(col.cast("string")), F.lit(True))
    if kind == "array":
        return F.coalesce(F.forall(col, lambda x: valid(schema.inner, x)), F.lit(True))
    if kind == "struct":
        return _all([valid(s, col[n]) for n, s in schema.parts])
    if kind == "enum":
        declared = F.coalesce(col["tag"].isin([t for _, t, _ in schema.parts]), F.lit(True))
        return _all([declared, *((col["tag"] != t) | valid(s, col[member(t)]) for _, t, s in schema.parts if s.kind != "unit")])
    if kind == "nested":
        table = schema.inner
        if table.kind == "map":
            key, value = table.parts
            return F.coalesce(F.forall(col, lambda e: valid(key, e["key"]) & valid(value, e["value"])), F.lit(True))
        # The bytes of a binary table are not looked at.
        return F.lit(True) if table.kind == "binary" else valid(table, col)
    return valid(schema.inner, col) if kind == "reversed" else F.lit(True)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def row_valid(table: Schema) -> Column:
    """Whether a row of a table satisfies the table's schema."""
    if table.kind == "map":
        return valid(table.parts[0], F.col("key")) & valid(table.parts[1], F.col("value"))
    if table.kind == "array" and table.inner.kind == "struct":
        return _all([valid(s, F.col(f"`{n}`")) for n, s in table.inner.parts])
    return valid(table.inner, F.col("value")) if table.kind == "array" else F.lit(True)


def check_shape(schema: Schema, found: T.DataType) -> None:
    """Raise unless a Spark type has the schema's kind, with struct fields of the same number, names and order."""
    kind = schema.kind
    if kind == "struct":
        if not isinstance(found, T.StructType):
            raise SchemaError.mismatch("Struct", found.simpleString())
        if len(found) != len(schema.parts):
            raise SchemaError.mismatch(f"struct with {len(schema.parts)} fields", f"struct with {len(found)} fields")
        for (name, inner), own in zip(schema.parts, found.fields, strict=True):
            if own.name != name:
                raise SchemaError.missing(name)
            check_shape(inner, own.dataType)
    elif kind == "array":
        if not isinstance(found, T.ArrayType):
            raise SchemaError.mismatch("Array", found.simpleString())
        check_shape(schema.inner, found.elementType)
    elif kind in ("reversed", "nested"):
        if schema.inner.kind != "map":
            check_shape(schema.inner, found)
    elif kind == "enum":
        tags = {member(t) for _, t, _ in schema.parts}
        if not isinstance(found, T.StructType) or not set(found.names) <= tags | {"tag"}:
            raise SchemaError.mismatch("Enum", found.simpleString())
    else:
        fits = {"int": T.IntegralType, "double": T.DoubleType, "binary": (T.BinaryType, T.StringType), "unit": T.NullType}[kind]
        if not isinstance(found, fits):
            raise SchemaError.mismatch(kind.capitalize(), found.simpleString())


def validate(df: DataFrame, table: Schema) -> DataFrame:
    """One row (rows, invalid, valid)."""
    bad = F.coalesce(F.sum(F.when(row_valid(table), 0).otherwise(1)), F.lit(0)).cast("long")
    return df.agg(F.count("*").alias("rows"), bad.alias("invalid")).withColumn("valid", F.col("invalid") == 0)


def strict(df: DataFrame, table: Schema) -> DataFrame:
    """The same rows; an action fails at an invalid one."""
    ok = F.when(row_valid(table), True).otherwise(F.raise_error(F.lit("Type mismatch: a row does not satisfy its schema")).cast("boolean"))
    return df.where(ok)
