"""Extractors: the value of a column or a table as one kind, or an error that names what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LogicalError
from ..schema import Schema, member, spark_type

_TYPES = {"int": T.IntegralType, "double": T.DoubleType, "binary": (T.BinaryType, T.StringType), "array": T.ArrayType, "struct": T.StructType}


def take(df: DataFrame, col: str, kind: str) -> Column:
    """The column, if its type is of ``kind``: int, double, binary, array or struct."""
    found = df.schema[col].dataType
    if not isinstance(found, _TYPES[kind]):
        raise LogicalError.invalid("value", f"expected {kind}, got {found.simpleString()}")
    return F.col(f"`{col}`")


def take_fields(df: DataFrame, col: str) -> DataFrame:
    """The fields of a struct column as columns."""
    take(df, col, "struct")
    return df.select(f"`{col}`.*")


def take_member(schema: Schema, col: Column, kind: str) -> Column:
    """Of an enum column the value of ``kind``; a row whose variant is of another kind fails."""
    own = [t for _, t, s in schema.parts if s.kind == kind]
    if not own:
        raise LogicalError.invalid("value", f"no variant is {kind}")
    out = spark_type(next(s for _, t, s in schema.parts if t == own[0]))
    text = F.concat(F.lit(f"Invalid value for field 'value': expected {kind}, got tag "), col["tag"].cast("string"))
    return F.when(col["tag"].isin(own), F.coalesce(*[col[member(t)].cast(out) for t in own])).otherwise(F.raise_error(text).cast(out))


def take_table(df: DataFrame, kind: str) -> DataFrame:
    """A table as ``binary`` (data), ``map`` (key, value) or ``array``: what its columns say."""
    found = {("data",): "binary", ("key", "value"): "map"}.get(tuple(c for c in df.columns if not c.startswith("_")), "array")
    if found != kind:
        raise LogicalError.invalid("table", f"expected {kind}, got {found}")
    return df
