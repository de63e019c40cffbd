"""The schema model, its two JSON dialects, its Spark types, and its self-check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import SchemaError

#: Encodings in tag order (fixed values).
INT_ENCODINGS = ("int", "date", "time_seconds", "time_milliseconds", "time_microseconds")
BINARY_ENCODINGS = ("binary", "utf8")
DEFAULTS = ("allow", "deny")
DATE_LIMIT = 4102444800000

# The dialect of file headers (fixed values).
_HEADER_INT = dict(zip(INT_ENCODINGS, ("Int", "Date", "TimeSeconds", "TimeMilliseconds", "TimeMicroseconds"), strict=True))
_HEADER_BINARY = {"binary": "Binary", "utf8": "Utf8"}


@dataclass(frozen=True)
class Schema:
    """A value's or a table's schema.

    ``kind`` of a value: unit, int, double, binary, array, struct, enum, nested,
    reversed; of a table: binary, array, map.  ``parts`` are (name, schema) of a
    struct, (name, tag, schema) of an enum, and otherwise the inner schemas.
    """

    kind: str
    encoding: str | None = None
    default: str = "allow"
    parts: tuple = ()

    @property
    def inner(self) -> Schema:
        return self.parts[0]


UNIT = Schema("unit")


def integer(encoding: str = "int", default: str = "allow") -> Schema:
    return Schema("int", encoding, default)


def double(default: str = "allow") -> Schema:
    return Schema("double", None, default)


def binary(encoding: str = "binary", default: str = "allow") -> Schema:
    return Schema("binary", encoding, default)


def utf8(default: str = "allow") -> Schema:
    return binary("utf8", default)


def array(element: Schema, default: str = "allow") -> Schema:
    return Schema("array", None, default, (element,))


def struct(*fields: tuple[str, Schema], default: str = "allow") -> Schema:
    return Schema("struct", None, default, tuple(fields))


def enum(*variants: tuple[str, int, Schema], default: str = "allow") -> Schema:
    return Schema("enum", None, default, tuple(variants))


def nested(table: Schema) -> Schema:
    return Schema("nested", parts=(table,))


def reverse(inner: Schema) -> Schema:
    return Schema("reversed", parts=(inner,))


def map_table(key: Schema, value: Schema, default: str = "allow") -> Schema:
    return Schema("map", None, default, (key, value))


def children(schema: Schema) -> list[Schema]:
    return [p[-1] if isinstance(p, tuple) else p for p in schema.parts]


def check(schema: Schema) -> Schema:
    """The schema itself, if no struct or enum in it is empty and no field name or tag repeats."""
    if schema.kind in ("struct", "enum"):
        if not schema.parts:
            raise SchemaError.unsupported(f"Empty {schema.kind} schemas are not supported")
        seen = set()
        for part in schema.parts:
            key = part[-2]
            if key in seen:
                raise SchemaError.unsupported(f"Duplicate {'field name' if schema.kind == 'struct' else 'enum tag'}: {key}")
            seen.add(key)
    for child in children(schema):
        check(child)
    return schema


def spark_type(schema: Schema) -> T.DataType:
    """The column type of a value; integers are LONG whatever their encoding, an enum is a struct of its tag and one member for each tag."""
    kind = schema.kind
    if kind == "binary":
        return T.StringType() if schema.encoding == "utf8" else T.BinaryType()
    if kind == "array":
        return T.ArrayType(spark_type(schema.inner), False)
    if kind == "struct":
        return T.StructType([field(n, s) for n, s in schema.parts])
    if kind == "enum":
        return T.StructType([T.StructField("tag", T.LongType(), False), *(T.StructField(member(t), spark_type(s)) for _, t, s in schema.parts)])
    if kind == "nested":
        return table_cell(schema.inner)
    if kind == "reversed":
        return spark_type(schema.inner)
    return {"unit": T.NullType(), "int": T.LongType(), "double": T.DoubleType()}[kind]


def table_cell(table: Schema) -> T.DataType:
    """The type of a table inside a cell; a map is an array of entries, as its order and its repeats count."""
    if table.kind == "map":
        key, value = table.parts
        return T.ArrayType(T.StructType([T.StructField("key", spark_type(key), False), T.StructField("value", spark_type(value))]), False)
    return spark_type(table)


def member(tag: int) -> str:
    return f"v_{tag}"


def field(name: str, schema: Schema) -> T.StructField:
    return T.StructField(name, spark_type(schema), schema.default != "deny", {"schema": to_json(schema)})


def row_type(table: Schema) -> T.StructType:
    """The columns of a table: those of a struct element, or ``value``; ``key`` and ``value``; ``data``."""
    if table.kind == "map":
        return T.StructType([field("key", table.parts[0]), field("value", table.parts[1])])
    if table.kind == "array":
        return spark_type(table.inner) if table.inner.kind == "struct" else T.StructType([field("value", table.inner)])
    return T.StructType([field("data", table)])


def infer(kind: T.DataType, metadata: dict | None = None) -> Schema:
    """The schema of a Spark type; the metadata that ``field`` leaves decides where a type alone does not."""
    if metadata and "schema" in metadata:
        return from_json(metadata["schema"])
    if isinstance(kind, T.ArrayType):
        return array(infer(kind.elementType))
    if isinstance(kind, T.StructType):
        if kind.names[:1] == ["tag"] and len(kind) > 1 and all(n.startswith("v_") for n in kind.names[1:]):
            return enum(*((f.name, int(f.name[2:]), infer(f.dataType, f.metadata)) for f in kind.fields[1:]))
        return struct(*((f.name, infer(f.dataType, f.metadata)) for f in kind.fields))
    simple = {T.NullType: UNIT, T.DoubleType: double(), T.FloatType: double(), T.StringType: utf8(), T.BinaryType: binary(), T.DateType: integer("date"), T.TimestampType: integer("time_microseconds"), T.TimestampNTZType: integer("time_microseconds")}
    if type(kind) in simple:
        return simple[type(kind)]
    if isinstance(kind, T.IntegralType) or isinstance(kind, T.BooleanType):
        return integer()
    raise SchemaError.unsupported(kind.simpleString())


def infer_table(rows: T.StructType) -> Schema:
    return array(infer(rows))


# The dialect of documents.


def to_json(schema: Schema) -> dict:
    out: dict = {"type": schema.kind}
    if schema.kind not in ("unit", "nested", "reversed"):
        out["default"] = schema.default
    if schema.encoding:
        out["encoding"] = schema.encoding
    if schema.kind == "array":
        out["element"] = to_json(schema.inner)
    elif schema.kind == "map":
        out["key"], out["value"] = map(to_json, schema.parts)
    elif schema.kind == "struct":
        out["fields"] = [{"name": n, "schema": to_json(s)} for n, s in schema.parts]
    elif schema.kind == "enum":
        out["variants"] = [{"name": n, "tag": t, "schema": to_json(s)} for n, t, s in schema.parts]
    elif schema.kind == "nested":
        out["table"] = to_json(schema.inner)
    elif schema.kind == "reversed":
        out["inner"] = to_json(schema.inner)
    return out


def from_json(doc: dict) -> Schema:
    kind = "struct" if doc.get("type") == "complex" else doc.get("type")
    default = doc.get("default") or "allow"
    if default not in DEFAULTS:
        raise SchemaError(f"Unknown default: {default}")
    encoding = doc.get("encoding") or {"int": "int", "binary": "binary"}.get(kind)
    if encoding and encoding not in {"int": INT_ENCODINGS, "binary": BINARY_ENCODINGS}.get(kind, (encoding,)):
        raise SchemaError(f"Unknown encoding: {encoding}")

    def need(key):
        if key not in doc:
            raise SchemaError.missing(key)
        return doc[key]

    if kind in ("int", "binary", "double", "unit"):
        return UNIT if kind == "unit" else Schema(kind, encoding if kind != "double" else None, default)
    if kind == "array":
        return array(from_json(need("element")), default)
    if kind == "map":
        return map_table(from_json(need("key")), from_json(need("value")), default)
    if kind == "struct":
        return struct(*((f["name"], from_json(f.get("schema") or {k: v for k, v in f.items() if k != "name"})) for f in need("fields")), default=default)
    if kind == "enum":
        return enum(*((v["name"], int(v["tag"]), from_json(v["schema"])) for v in need("variants")), default=default)
    if kind == "nested":
        return nested(from_json(need("table")))
    if kind == "reversed":
        return reverse(from_json(need("inner")))
    raise SchemaError.unsupported(kind)


# The dialect of file headers: one key that names the variant.


def _encoding_header(encoding: str) -> dict:
    return {"Int": _HEADER_INT[encoding]} if encoding in _HEADER_INT else {"Binary": _HEADER_BINARY[encoding]}


def to_header(schema: Schema):
    default = {"default": schema.default.capitalize()}
    encoding = {"encoding": _encoding_header(schema.encoding)} if schema.encoding else {}
    kind = schema.kind
    if kind == "unit":
        return "Unit"
    if kind in ("int", "double", "binary"):
        return {kind.capitalize(): default | encoding}
    if kind == "array":
        return {"Array": default | {"element": to_header(schema.inner)}}
    if kind == "map":
        return {"Map": default | {"key": to_header(schema.parts[0]), "value": to_header(schema.parts[1])}}
    if kind == "struct":
        return {"Struct": default | {"fields": [{"name": n, "schema": to_header(s)} for n, s in schema.parts]}}
    if kind == "enum":
        return {"Enum": default | {"variants": [{"name": n, "tag": t, "schema": to_header(s)} for n, t, s in schema.parts]}}
    return {"Nested": {"table": to_header(schema.inner)}} if kind == "nested" else {"Reversed": {"inner": to_header(schema.inner)}}


def from_header(doc) -> Schema:
    if doc == "Unit":
        return UNIT
    ((name, body),) = doc.items()
    default = body.get("default", "Allow").lower()
    encoding = None
    if "encoding" in body:
        ((family, own),) = body["encoding"].items()
        encoding = {v: k for k, v in (_HEADER_INT if family == "Int" else _HEADER_BINARY).items()}[own]
    if name in ("Int", "Double", "Binary"):
        return Schema(name.lower(), encoding, default)
    if name == "Array":
        return array(from_header(body["element"]), default)
    if name == "Map":
        return map_table(from_header(body["key"]), from_header(body["value"]), default)
    if name == "Struct":
        return struct(*((f["name"], from_header(f["schema"])) for f in body["fields"]), default=default)
    if name == "Enum":
        return enum(*((v["name"], v["tag"], from_header(v["schema"])) for v in body["variants"]), default=default)
    if name == "Nested":
        return nested(from_header(body["table"]))
    if name == "Reversed":
        return reverse(from_header(body["inner"]))
    raise SchemaError.unsupported(name)
