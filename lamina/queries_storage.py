"""The catalogue's second part: schemas, documents, files, striped blocks, conversions, extraction and errors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors
from . import schema as S
from .errors import ConversionError
from .operators import defaults, extract, merge, stripe
from .operators import validate as V
from .plans import convert as C
from .queries import EVENT, LIMIT, _events, _millis, query
from .sources import blocks as B
from .sources import files


def _table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def _values(*rows: tuple) -> str:
    """SQL for the expected rows (name, result)."""
    quoted = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)
    return f"select * from (values {quoted}) v(name, result)"


def _told(cases: dict, call) -> list[tuple[str, str]]:
    """For each case what ``call`` returns, or the text of its error."""
    out = []
    for name, case in cases.items():
        try:
            out.append((name, str(call(case))))
        except ConversionError as e:
            out.append((name, f"{type(e).__name__}: {e}"))
    return out


def _spark(t) -> SparkSession:
    return t("region").sparkSession


# Schemas.

_DOCS = {
    "int": {"type": "int"},
    "time": {"type": "int", "encoding": "time_seconds", "default": "deny"},
    "text": {"type": "binary", "encoding": "utf8"},
    "complex": {"type": "complex", "fields": [{"name": "a", "schema": {"type": "double"}}]},
    "array": {"type": "array", "element": {"type": "unit"}},
    "enum": {"type": "enum", "variants": [{"name": "n", "tag": 7, "schema": {"type": "int"}}]},
    "map": {"type": "nested", "table": {"type": "map", "key": {"type": "int"}, "value": {"type": "reversed", "inner": {"type": "int"}}}},
    "wrong encoding": {"type": "int", "encoding": "utf8"},
    "wrong family": {"type": "binary", "encoding": "date"},
    "wrong default": {"type": "int", "default": "maybe"},
    "bool": {"type": "bool"},
    "no element": {"type": "array"},
}


@query(
    _values(
        ("int", "bigint int allow"),
        ("time", "bigint time_seconds deny"),
        ("text", "string utf8 allow"),
        ("complex", "struct<a:double> None allow"),
        ("array", "array<void> None allow"),
        ("enum", "struct<tag:bigint,v_7:bigint> None allow"),
        ("map", "array<struct<key:bigint,value:bigint>> None allow"),
        ("wrong encoding", "SchemaError: Unknown encoding: utf8"),
        ("wrong family", "SchemaError: Unknown encoding: date"),
        ("wrong default", "SchemaError: Unknown default: maybe"),
        ("bool", "SchemaError: Unsupported type: bool"),
        ("no element", "SchemaError: Missing required field: element"),
    )
)
def schema_documents(t):
    """Schema documents of values: the column type, encoding and policy they tell, or the error; what is read is written again alike."""

    def call(doc):
        found = S.from_json(doc)
        assert S.from_json(S.to_json(found)) == found == S.from_header(S.to_header(found))
        return f"{S.spark_type(found).simpleString()} {found.encoding} {found.default}"

    return _table(_spark(t), _told(_DOCS, call), "name string, result string")


@query(
    _values(
        ("good", "ok"),
        ("empty enum", "SchemaError: Unsupported type: Empty enum schemas are not supported"),
        ("empty struct in a table", "SchemaError: Unsupported type: Empty struct schemas are not supported"),
        ("field twice", "SchemaError: Unsupported type: Duplicate field name: a"),
        ("tag twice in a map", "SchemaError: Unsupported type: Duplicate enum tag: 1"),
    )
)
def schema_selfcheck(t):
    cases = {
        "good": S.array(EVENT),
        "empty enum": S.enum(),
        "empty struct in a table": S.array(S.reverse(S.struct())),
        "field twice": S.struct(("a", S.UNIT), ("a", S.integer())),
        "tag twice in a map": S.map_table(S.integer(), S.array(S.enum(("x", 1, S.UNIT), ("y", 1, S.UNIT)))),
    }
    return _table(_spark(t), _told(cases, lambda s: "ok" if S.check(s) is s else "changed"), "name string, result string")


@query(
    _values(
        ("customer", "c_custkey int int, c_name binary utf8, c_nationkey int int, c_acctbal double None, c_mktsegment binary utf8"),
        ("embeddings", "vec_id int int, embedding array None, label int int"),
        ("orders", "o_orderkey int int, o_custkey int int, o_orderstatus binary utf8, o_totalprice double None, o_orderdate int time_microseconds, o_orderpriority binary utf8"),
        ("striped events", "e enum None: 0 double, 1 binary, 2 unit, 3 int, 4 int"),
    )
)
def infer_schema(t):
    """Schemas told by tables, and by a striped block of all events' variants."""
    out = []
    for name in ("customer", "embeddings", "orders"):
        out.append((name, ", ".join(f"{n} {s.kind} {s.encoding}" for n, s in files.table_schema(t(name)).inner.parts)))
    block = B.block_of(S.array(S.struct(("e", EVENT))), [{"e": {"tag": k, f"v_{k}": v}} for k, v in enumerate((0.5, "x", None, 1, 2))])
    ((name, found),) = block.schema.inner.parts
    out.append(("striped events", f"{name} {found.kind} {found.encoding}: " + ", ".join(f"{k} {s.kind}" for _, k, s in found.parts)))
    return _table(_spark(t), out, "name string, result string")


# Values of documents.


@query(
    _values(
        ("whole number as int", "7"),
        ("whole number as double", "SchemaError: Type mismatch: expected Double, got int"),
        ("fraction as int", "SchemaError: Type mismatch: expected Int, got float"),
        ("beyond 64 bits", "SchemaError: Type mismatch: expected Int, got int"),
        ("null as unit", "None"),
        ("number as unit", "SchemaError: Type mismatch: expected Unit, got int"),
        ("bool", "SchemaError: Unsupported type: bool"),
        ("text as bytes", "b'a'"),
        ("struct", "{'a': 1}"),
        ("struct without its key", "SchemaError: Type mismatch: expected Struct, got object"),
        ("struct with a field more", "SchemaError: Type mismatch: expected struct with 1 fields, got struct with 2 fields"),
        ("struct with another field", "SchemaError: Missing required field: a"),
        ("array", "[1, 2]"),
    )
)
def document_values(t):
    one = S.struct(("a", S.integer()))
    cases = {
        "whole number as int": (S.integer(), 7),
        "whole number as double": (S.double(), 7),
        "fraction as int": (S.integer(), 7.5),
        "beyond 64 bits": (S.integer(), 1 << 63),
        "null as unit": (S.UNIT, None),
        "number as unit": (S.UNIT, 5),
        "bool": (S.integer(), True),
        "text as bytes": (S.binary(), "a"),
        "struct": (one, {"struct": {"a": 1}}),
        "struct without its key": (one, {"a": 1}),
        "struct with a field more": (one, {"struct": {"a": 1, "x": 2}}),
        "struct with another field": (one, {"struct": {"b": 1}}),
        "array": (S.array(S.integer()), [1, 2]),
    }
    return _table(_spark(t), _told(cases, lambda c: files.value_from_json(*c)), "name string, result string")


# Files.


def _stored(t, name: str, df: DataFrame, **options) -> tuple[SparkSession, str]:
    spark = df.sparkSession
    spark.dataSource.register(files.BinarySource)
    path = f"{files.work_folder(spark)}/{name}"
    df.write.format("lamina").options(path=path, **options).mode("append").save()
    return spark, path


@query("select o_orderkey, o_totalprice, o_orderstatus from orders")
def binary_roundtrip(t):
    """The binary format written and read by executors, in blocks, files and Arrow batches."""
    spark, path = _stored(t, "orders", t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), block_rows="500", file_blocks="8")
    return spark.read.format("lamina").option("path", path).load()


@query("select event_id, value from events where event_id < 1000")
def block_first(t):
    """The first block of a file of blocks of 1000 rows in the order of event_id."""
    one = t("events").select("event_id", "value").coalesce(1).sortWithinPartitions("event_id")
    spark, path = _stored(t, "events", one, block_rows="1000", file_blocks="1000000", first_block="true")
    return spark.read.format("lamina").option("path", path).option("first_block", "true").load()


_ROW = S.struct(("event_id", S.integer()), ("e", EVENT), ("rows", S.nested(S.array(S.integer()))), ("entries", S.nested(S.map_table(S.integer(), S.utf8()))), ("back", S.reverse(S.integer("date"))), ("raw", S.binary()), ("sizes", S.array(S.double())))
_ROW_SQL = f"""select event_id, (ascii(substr(event_type, 1, 1)) + length(event_type)) % 5 as tag, case when (ascii(substr(event_type, 1, 1)) + length(event_type)) % 5 = 1 then props when (ascii(substr(event_type, 1, 1)) + length(event_type)) % 5 = 3 then user_id::varchar end as shown,
 event_id % 3 as n_rows, case when event_id % 3 > 0 then user_id end as head, case when event_id % 2 = 0 then props end as entry, epoch_us(ts) // 1000 as back, event_type as raw, value as size from events"""


def _rich(t) -> DataFrame:
    """Events with a column of every kind: enum, nested array, nested map, reversed date, bytes, doubles."""
    e = _events(t).join(t("events").select("event_id", "user_id", "props", "event_type", "value", _millis("ts").alias("back")), "event_id")
    rows = F.slice(F.array("user_id", F.col("user_id") + 1), 1, (F.col("event_id") % 3).cast("int"))
    entry = F.struct(F.col("event_id").alias("key"), F.col("props").alias("value"))
    entries = F.filter(F.array(entry), lambda x: x["key"] % 2 == 0)
    return e.select("event_id", "block", "e", rows.alias("rows"), entries.alias("entries"), "back", F.col("event_type").cast("binary").alias("raw"), F.array("value").alias("sizes"))


def _shown(df: DataFrame) -> DataFrame:
    shown = F.coalesce("e.v_1", F.col("e.v_3").cast("string")).alias("shown")
    return df.select("event_id", "e.tag", shown, F.size("rows").cast("long").alias("n_rows"), F.get("rows", F.lit(0)).alias("head"), F.get("entries", F.lit(0))["value"].alias("entry"), "back", F.col("raw").cast("string").alias("raw"), F.get("sizes", F.lit(0)).alias("size"))


@query(_ROW_SQL)
def file_images(t):
    """Every column kind through file images of blocks, made and read on executors."""
    table = S.array(_ROW)
    return _shown(files.rows_of_images(files.file_images(_rich(t), table, "block", "event_id"), table))


@query(_ROW_SQL)
def file_images_plain(t):
    """The same without compression of bytes and with another writer's leading bytes."""
    table, magic = S.array(_ROW), b"0123456789abcdef"
    return _shown(files.rows_of_images(files.file_images(_rich(t), table, "block", "event_id", "None", magic), table, magic))


@query(_ROW_SQL)
def striped_documents(t):
    """Every column kind through striped JSON documents of blocks."""
    table = S.array(_ROW)
    return _shown(files.rows_of_documents(files.striped_documents(_rich(t), table, "block", "event_id"), table))


@query("select p_partkey // 500 as block, count(*) as n, sum(octet_length(encode(p_name)))::bigint as n_bytes, count(*) as n_names from part group by 1")
def striped_lengths(t):
    """What striped documents of map tables hold: keys, and lengths and texts of the values."""
    table = S.map_table(S.integer(), S.utf8())
    entries = t("part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"), stripe.at_most_one_block("p_partkey", 500).alias("block"))
    docs = files.striped_documents(entries, table, "block", "key")
    kind = "key_column struct<values: array<long>>, value_column struct<lengths: array<long>, data: array<string>>"
    doc = docs.select("block", F.from_json("doc", kind).alias("d"))
    total = F.aggregate("d.value_column.lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    return doc.select("block", F.size("d.key_column.values").cast("long").alias("n"), total.alias("n_bytes"), F.size("d.value_column.data").cast("long").alias("n_names"))


@query("select p_partkey as key, p_name as value from part")
def striped_maps(t):
    table = S.map_table(S.integer(), S.utf8())
    entries = t("part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"), stripe.at_most_one_block("p_partkey", 500).alias("block"))
    return files.rows_of_documents(files.striped_documents(entries, table, "block", "key"), table)


@query(
    _values(
        ("magic", "BinaryError: Invalid magic number in binary file"),
        ("short", "BinaryError: Corrupted data: the file ends early"),
        ("table tag", "BinaryError: Invalid table tag: 9"),
        ("default tag", "BinaryError: Invalid default tag: 9"),
        ("column tag", "BinaryError: Invalid column tag: 9"),
        ("rows", "BinaryError: Corrupted data: 9 rows announced, 3 found"),
        ("keys and values", "StripedError: Column count mismatch: expected 2, got 1"),
        ("array lengths", "StripedError: Vector operation failed: array length mismatch"),
        ("byte lengths", "StripedError: Vector operation failed: binary length mismatch"),
        ("text among numbers", "SchemaError: Type mismatch: expected Int, got another JSON value"),
        ("codec header", "BinaryError: Decompression failed: no header"),
        ("codec size", "BinaryError: Decompression failed: 6 bytes expected, 5 found"),
        ("unknown conversion", "ConversionError: Unsupported conversion: striped to json"),
    )
)
def storage_errors(t):
    """Damaged files, blocks that do not add up, and codecs' errors."""
    from .functions import encode as E

    table = S.array(S.integer())
    good = B.to_bytes(table, [B.block_of(table, [1, 2, 3])])
    at = good.rindex(bytes([1, 0, 1, 0, 0, 0]))  # table array, allow, column int, allow, encoding int, plain

    def damaged(i: int, x: int) -> bytes:
        return good[:i] + bytes([x]) + good[i + 1 :]

    ints = B.from_values(S.integer(), [1, 2])
    cases = {
        "magic": lambda: B.from_bytes(b"x" + good[1:]),
        "short": lambda: B.from_bytes(good[:-1]),
        "table tag": lambda: B.from_bytes(damaged(at, 9)),
        "default tag": lambda: B.from_bytes(damaged(at + 1, 9)),
        "column tag": lambda: B.from_bytes(damaged(at + 2, 9)),
        "rows": lambda: B.from_bytes(damaged(at - 4, 9)),
        "keys and values": lambda: B.rows_of(B.Block("map", columns=[ints, B.from_values(S.integer(), [1])])),
        "array lengths": lambda: B.to_values(B.Column("array", lengths=[1], parts=[ints])),
        "byte lengths": lambda: B.to_values(B.Column("binary", encoding="binary", lengths=[1], data=b"ab")),
        "text among numbers": lambda: B.column_from_json({"type": "int", "values": ["x"]}),
        "codec header": lambda: E.decompress_ints(b"short", 1),
        "codec size": lambda: E.decompress_bytes(b"12345", 6, None),
        "unknown conversion": lambda: C.convert(_spark(t), "-", "-", "striped", "json"),
    }
    return _table(_spark(t), _told(cases, lambda f: f()), "name string, result string")


@query(
    _values(
        ("int", "LogicalError: Invalid value for field 'value': expected double, got bigint"),
        ("array", "LogicalError: Invalid value for field 'value': expected struct, got array<float>"),
        ("table", "LogicalError: Invalid value for field 'table': expected map, got array"),
        ("missing", "SchemaError: Missing required field: c_nothing"),
        ("shape", "SchemaError: Type mismatch: expected struct with 1 fields, got struct with 5 fields"),
        ("order", "SchemaError: Missing required field: c_name"),
        ("enum", "SchemaError: Unsupported type: Enum tag 150"),
    )
)
def logical_errors(t):
    """Extraction and validation of the wrong kind, on the driver."""
    customer, vectors = t("customer"), t("embeddings")
    two = customer.select("c_custkey", "c_name")
    made = customer.select("c_custkey", F.struct("c_name").alias("s"))
    cases = {
        "int": lambda: extract.take(customer, "c_custkey", "double"),
        "array": lambda: extract.take_fields(vectors, "embedding"),
        "table": lambda: extract.take_table(customer, "map"),
        "missing": lambda: stripe.struct_columns(made, "s", S.struct(("c_nothing", S.utf8())), "c_custkey"),
        "shape": lambda: V.check_shape(S.struct(("c_custkey", S.integer())), customer.schema),
        "order": lambda: V.check_shape(S.struct(("c_name", S.utf8()), ("c_custkey", S.integer())), two.schema),
        "enum": lambda: B.from_values(EVENT, [{"tag": 150}]),
    }
    return _table(_spark(t), _told(cases, lambda f: f()), "name string, result string")


@query(
    _values(
        ("conversion", "Schema error: x"),
        ("mismatch", "Type mismatch: expected Int, got str"),
        ("missing", "Missing required field: a"),
        ("unsupported", "Unsupported type: bool"),
        ("invalid", "Invalid value for field 'int': cannot merge 1 and 2"),
        ("structure", "Structure mismatch: enum tags differ"),
        ("columns", "Column count mismatch: expected 2, got 1"),
        ("vector", "Vector operation failed: array length mismatch"),
    )
)
def error_texts(t):
    found = {
        "conversion": errors.ConversionError("Schema error: x"),
        "mismatch": errors.SchemaError.mismatch("Int", "str"),
        "missing": errors.SchemaError.missing("a"),
        "unsupported": errors.SchemaError.unsupported("bool"),
        "invalid": errors.LogicalError.invalid("int", "cannot merge 1 and 2"),
        "structure": errors.LogicalError.structure("enum tags differ"),
        "columns": errors.StripedError.columns(2, 1),
        "vector": errors.StripedError.vector("array length mismatch"),
    }
    assert all(isinstance(e, ConversionError) for e in found.values())
    return _table(_spark(t), [(n, str(e)) for n, e in found.items()], "name string, result string")


# Conversions.


def _documents(t, name: str, df: DataFrame, schema: S.Schema) -> tuple[SparkSession, str, str]:
    """A small table as a JSON document in a new folder."""
    spark = df.sparkSession
    folder = files.work_folder(spark)
    path = f"{folder}/{name}.json"
    files.write_bytes(path, files.write_document(schema, [files.plain(r) for r in df.collect()]).encode())  # one document is one file
    return spark, folder, path


_NATION = S.array(S.struct(("n_nationkey", S.integer()), ("n_name", S.utf8()), ("n_regionkey", S.integer())))


@query("select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation")
def convert_chain(t):
    """All nations from a JSON document through logical, striped and binary files and back."""
    spark, folder, at = _documents(t, "nation", t("nation"), _NATION)
    for of, to in (("json", "logical"), ("logical", "striped"), ("striped", "binary"), ("binary", "striped"), ("striped", "binary"), ("binary", "logical"), ("logical", "binary"), ("binary", "json")):
        C.convert(spark, at, f"{folder}/nation.{to}", of, to)
        at = f"{folder}/nation.{to}"
    return files.frame(spark, *files.read_document(files.read_text(at)))


@query("select k as format, (select count(*) from supplier) as rows, 1::bigint as blocks, true as valid, 'date' as encoding from (values ('json'), ('striped'), ('binary')) v(k) union all select 'late', (select count(*) from supplier), 1, false, 'date'")
def file_info(t):
    schema = S.array(S.struct(("s_suppkey", S.integer("date")), ("s_name", S.utf8())))
    spark, folder, path = _documents(t, "supplier", t("supplier").select("s_suppkey", "s_name"), schema)
    late = t("supplier").select((-F.col("s_suppkey")).alias("s_suppkey"), "s_name")
    out = []
    for name in ("json", "striped", "binary", "late"):
        at = path if name == "json" else f"{folder}/supplier.{name}"
        if name == "late":
            at = _documents(t, "late", late, schema)[2]
        elif name != "json":
            C.convert(spark, path, at, "json", name)
        got = C.info(spark, at)
        out.append((name, got["rows"], got["blocks"], got["valid"], got["schema"]["element"]["fields"][0]["schema"]["encoding"]))
    return _table(spark, out, "format string, rows long, blocks long, valid boolean, encoding string")


@query(
    _values(
        ("good", "valid, roundtrip True"),
        ("late", "rows do not satisfy the schema, roundtrip True"),
        ("field more", "Type mismatch: expected struct with 1 fields, got struct with 2 fields, roundtrip None"),
        ("no key", "Type mismatch: expected Struct, got object, roundtrip None"),
        ("fraction", "Type mismatch: expected Int, got float, roundtrip None"),
        ("no list", "Type mismatch: expected Array, got dict, roundtrip None"),
    )
)
def validate_documents(t):
    """Documents checked against a schema file."""
    spark = _spark(t)
    folder = files.work_folder(spark)
    rule = f"{folder}/schema.json"
    files.write_bytes(rule, json.dumps(S.to_json(S.array(S.struct(("at", S.integer("date")))))).encode())
    cases = {
        "good": [{"struct": {"at": 5}}],
        "late": [{"struct": {"at": LIMIT + 1}}],
        "field more": [{"struct": {"at": 1, "x": 2}}],
        "no key": [{"at": 1}],
        "fraction": [{"struct": {"at": 1.5}}],
        "no list": {"struct": {"at": 1}},
    }
    found = []
    for name, data in cases.items():
        path = f"{folder}/{name}.json"
        files.write_bytes(path, json.dumps({"schema": {}, "data": data}).encode())
        got = C.validate_files(spark, path, rule)
        found.append((name, f"{'valid' if got['valid'] else got['reason']}, roundtrip {got['roundtrip']}"))
    return _table(spark, found, "name string, result string")


@query("select * from (values ('numbers.json', 12, true), ('people.json', 4, true)) v(name, n, valid)")
def example_files(t):
    spark = _spark(t)
    found = [(p.rpartition("/")[2], C.info(spark, p)) for p in C.examples(files.work_folder(spark))]
    return _table(spark, [(name, i["rows"], i["valid"]) for name, i in found], "name string, n int, valid boolean")


# Nested values, defaults and extraction.


@query(f"select o_orderkey, o_custkey % 4 <> 1 and o_custkey % 3 <> 2 and epoch_us(o_orderdate) // 1000 between 0 and {LIMIT} as ok from orders")
def validate_nested(t):
    """A nested map of reversed dates and texts, and a nested array: a wrong key, and a wrong element."""
    schema = S.struct(("m", S.nested(S.map_table(S.reverse(S.integer("date")), S.utf8()))), ("a", S.nested(S.array(S.integer("date")))))
    key = F.when(F.col("o_custkey") % 4 == 1, F.lit(-1).cast("long")).otherwise(_millis("o_orderdate"))
    element = F.when(F.col("o_custkey") % 3 == 2, F.lit(LIMIT + 1)).otherwise(F.lit(LIMIT))
    cell = F.struct(F.array(F.struct(key.alias("key"), F.col("o_orderstatus").alias("value"))).alias("m"), F.array(F.lit(0).cast("long"), element).alias("a"))
    return t("orders").select("o_orderkey", V.valid(schema, cell).alias("ok"))


@query("select string_agg(r_name, '' order by r_regionkey) as data from region")
def merge_binary(t):
    data = lambda: stripe.blobs(t("region").withColumn("block", F.lit(0)), "r_name", "block", "r_regionkey").select("data")
    return merge.merge_binary_tables(data(), data()).select(F.col("data").cast("string").alias("data"))


@query("select * from (values ('array', 0::bigint, 'value bigint'), ('binary', 0, 'data binary'), ('map', 0, 'key bigint, value array<double>'), ('rows', 0, 'c_custkey bigint, c_name string, c_acctbal double')) v(kind, n, columns)")
def default_tables(t):
    spark, out = _spark(t), None
    kinds = {"array": S.array(S.integer()), "binary": S.binary(), "map": S.map_table(S.integer(), S.array(S.double())), "rows": S.array(S.struct(("c_custkey", S.integer()), ("c_name", S.utf8()), ("c_acctbal", S.double())))}
    for name, table in kinds.items():
        df = defaults.default_table(spark, table)
        shown = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        one = df.agg(F.lit(name).alias("kind"), F.count("*").alias("n"), F.lit(shown).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out.select("kind", "n", "columns")


@query("select event_id, case when (ascii(substr(event_type, 1, 1)) + length(event_type)) % 5 = 3 then user_id else epoch_us(ts) // 1000 end as taken from events where (ascii(substr(event_type, 1, 1)) + length(event_type)) % 5 in (3, 4)")
def take_member(t):
    """Of the events' enum the integers: a user or a moment."""
    return _events(t).where("e.tag in (3, 4)").select("event_id", extract.take_member(EVENT, F.col("e"), "int").alias("taken"))


@query("select vec_id, label::bigint as label, embedding[1] as head from embeddings")
def take_values(t):
    e = t("embeddings")
    return e.select(extract.take(e, "vec_id", "int"), extract.take(e, "label", "int").cast("long").alias("label"), F.get(extract.take(e, "embedding", "array"), F.lit(0)).alias("head"))


@query("select 'array' as kind, count(*) as n from orders union all select 'map', count(*) from part union all select 'binary', 1")
def take_tables(t):
    entries = t("part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))
    data = stripe.blobs(t("region").withColumn("block", F.lit(0)), "r_name", "block", "r_regionkey").select("data")
    out = None
    for kind, df in (("array", t("orders")), ("map", entries), ("binary", data)):
        one = extract.take_table(df, kind).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.select("kind", "n")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem")
def unstripe_nested(t):
    """Nested tables striped to lengths and rows and built again, in a reversed wrapper that leaves them as they are."""
    orders = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("rows"))
    back = stripe.array_rows(stripe.lengths(orders, "rows", "l_orderkey"), stripe.elements(orders, "rows", "l_orderkey"), "rows", "l_orderkey")
    return back.select("l_orderkey", F.explode("rows").alias("x")).select("l_orderkey", "x.*")


@query("select * from (values ('none', 300000), ('zstd', 300000)) v(codec, n_bytes)")
def codec_choices(t):
    """A file image of 300,000 equal bytes reads back under either codec, and Zstd makes it a hundred times smaller."""
    table = S.binary()
    out, sizes = [], {}
    for name, codec in (("none", "None"), ("zstd", B.ZSTD)):
        image = B.to_bytes(table, [B.block_of(table, b"\0" * 300000)], codec, codec)
        sizes[name] = len(image)
        out.append((name, len(B.from_bytes(image)[1][0].data)))
    assert sizes["zstd"] * 100 < sizes["none"]
    return _table(_spark(t), out, "codec string, n_bytes int")
