"""Merging two values or two tables of one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Schema, member, spark_type

EPSILON = 2.220446049250313e-16


def conflict(field: str, a: Column, b: Column, schema: Schema) -> Column:
    text = F.concat(F.lit(f"Invalid value for field '{field}': cannot merge "), F.coalesce(a.cast("string"), F.lit("null")), F.lit(" and "), F.coalesce(b.cast("string"), F.lit("null")))
    return F.raise_error(text).cast(spark_type(schema))


def doubles_agree(a: Column, b: Column) -> Column:
    """Nearer than the machine epsilon; NaN and equal infinities do not agree, as their difference is NaN."""
    gap = F.abs(a - b)
    return (gap < EPSILON) & ~F.isnan(gap)


def agree(schema: Schema, a: Column, b: Column) -> Column:
    """Whether merging succeeds."""
    kind = schema.kind
    if kind == "double":
        return doubles_agree(a, b)
    if kind == "struct":
        out = F.lit(True)
        for name, inner in schema.parts:
            out = out & agree(inner, a[name], b[name])
        return out
    if kind == "enum":
        out = a["tag"] == b["tag"]
        for _, tag, inner in schema.parts:
            if inner.kind != "unit":
                out = out & ((a["tag"] != tag) | agree(inner, a[member(tag)], b[member(tag)]))
        return out
    if kind == "nested":
        return agree(schema.inner, a, b) if schema.inner.kind == "binary" else F.lit(True)
    if kind == "reversed":
        return agree(schema.inner, a, b)
    return F.lit(True) if kind in ("array", "unit") else a == b


def merged(schema: Schema, a: Column, b: Column, field: str = "value") -> Column:
    """The merged value: arrays are joined, structs and enums merge by part, everything else must agree and keeps the left."""
    kind = schema.kind
    if kind in ("unit",):
        return a
    if kind == "array":
        return F.concat(a, b)
    if kind == "struct":
        return F.struct(*[merged(s, a[n], b[n], n).alias(n) for n, s in schema.parts])
    if kind == "enum":
        same = F.when(a["tag"] == b["tag"], a["tag"]).otherwise(F.raise_error(F.lit("Structure mismatch: enum tags differ")).cast("long"))
        parts = [(F.when(a["tag"] == t, merged(s, a[member(t)], b[member(t)], n)) if s.kind != "unit" else F.lit(None)).alias(member(t)) for n, t, s in schema.parts]
        return F.struct(same.alias("tag"), *parts)
    if kind == "nested":
        return merge_map_cells(schema.inner, a, b) if schema.inner.kind == "map" else merged(schema.inner, a, b, field)
    if kind == "reversed":
        return merged(schema.inner, a, b, field)
    return F.when(agree(schema, a, b), a).otherwise(conflict(schema.kind, a, b, schema))


def merge_map_cells(table: Schema, a: Column, b: Column) -> Column:
    """Entries of the left, each new key of the right appended; an equal key merges with the first entry that has it."""
    value = table.parts[1]

    def add(entries, right):
        at = F.array_position(F.transform(entries, lambda e: e["key"]), right["key"])
        changed = F.transform(entries, lambda e, i: F.when(i + 1 == at, F.struct(e["key"].alias("key"), merged(value, e["value"], right["value"]).alias("value"))).otherwise(e))
        return F.when(at == 0, F.concat(entries, F.array(right))).otherwise(changed)

    return F.aggregate(b, a, add)


def merge_array_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of both with ``_src`` 0 or 1; with each side's ``_pos`` they say the order: left, then right."""
    return left.withColumn("_src", F.lit(0)).unionByName(right.withColumn("_src", F.lit(1)))


def merge_map_tables(left: DataFrame, right: DataFrame, value: Schema) -> DataFrame:
    """(key, value, _src, _pos) of two map tables (key, value, _pos).

    A key of the right merges into the left's first entry of that key, or into
    the right's own first; later left entries of a key stay as they are.  Only
    scalar values, where merging is agreement with the first, are allowed.  A
    null agrees with nulls alone.
    """
    if value.kind not in ("int", "double", "binary"):
        raise ValueError("nested values merge as cells: merge_map_cells")
    both = merge_array_tables(left, right).select("key", "value", "_src", "_pos")
    # A first entry is found by aggregation; a hot key is combined before the shuffle.
    right_value = F.when(F.col("_src") == 1, F.col("value"))
    nulls = F.count_if((F.col("_src") == 1) & F.col("value").isNull()).alias("nulls")
    firsts = both.groupBy("key").agg(F.min(F.struct("_src", "_pos", "value")).alias("f"), F.min(right_value).alias("low"), F.max(right_value).alias("high"), nulls)
    first = F.col("f.value")
    alike = (F.col("nulls") == 0) & agree(value, first, F.col("low")) & agree(value, first, F.col("high"))
    fine = F.when(F.col("low").isNull(), (F.col("nulls") == 0) | first.isNull()).otherwise(F.coalesce(alike, F.lit(False)))
    checked = F.when(fine, first).otherwise(conflict("value", first, F.when(agree(value, first, F.col("low")), F.col("high")).otherwise(F.col("low")), value))
    kept = firsts.select("key", checked.alias("value"), F.col("f._src").alias("_src"), F.col("f._pos").alias("_pos"))
    again = left.select("key", "_pos").join(firsts.where("f._src = 0").select("key", F.col("f._pos").alias("at")), "key").where(F.col("_pos") > F.col("at")).select("key", "_pos")
    repeats = left.join(again, ["key", "_pos"], "left_semi").select("key", "value", F.lit(0).alias("_src"), "_pos")
    return kept.unionByName(repeats)


def merge_binary_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """The one row (data) of two binary tables, which must be equal; a side of several rows is no binary table."""
    sides = left.select("data", F.lit(0).alias("_src")).unionByName(right.select("data", F.lit(1).alias("_src")))
    of = lambda src: F.when(F.col("_src") == src, F.col("data"))
    one = sides.agg(F.min(of(0)).alias("a"), F.min(of(1)).alias("b"), F.count_if(F.col("_src") == 0).alias("n"), F.count_if(F.col("_src") == 1).alias("m"))
    same = F.when((F.col("n") > 1) | (F.col("m") > 1), F.raise_error(F.lit("Structure mismatch: a binary table has one row")).cast("binary"))
    # An empty table has no row.
    return one.select(same.when(F.coalesce("a", F.lit(b"")) == F.coalesce("b", F.lit(b"")), F.col("a")).otherwise(F.raise_error(F.lit("Structure mismatch: binary tables differ")).cast("binary")).alias("data"))
