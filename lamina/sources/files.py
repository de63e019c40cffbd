"""Tables in files: Parquet with Zstd, the binary format as a Spark data source, and JSON documents."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import SchemaError
from ..schema import Schema, array, check, from_json, infer, member, row_type, spark_type, to_json
from . import blocks as B

BLOCK_ROWS = 1000
#: A task holds the blocks of one file.
FILE_BLOCKS = 64


def write_table(df: DataFrame, path: str, codec: str = "zstd", level: int = 3, mode: str = "errorifexists") -> None:
    """The native store: Parquet, Zstd 3 unless told otherwise (``uncompressed`` for none)."""
    writer = df.write.mode(mode).option("compression", codec)
    if codec == "zstd":
        writer = writer.option("parquet.compression.codec.zstd.level", str(level))
    writer.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table_schema(df: DataFrame) -> Schema:
    """The schema that a DataFrame's types and metadata tell."""
    return array(infer(df.schema))


def plain(value):
    """Rows as dicts, all the way down."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return bytes(value) if isinstance(value, bytearray) else value


class BlockFile(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class BinarySource(DataSource):
    """``spark.read.format("lamina")``: files of the binary format in a folder that all executors see.

    The folder is a path or the URI of any file system that Arrow opens (file,
    hdfs, s3, gs).  A partition is written as files of at most ``file_blocks``
    blocks of ``block_rows`` rows; a file is read as one partition, a block at a
    time, and its rows leave as Arrow batches.  Options: path, schema (a JSON
    schema document, needed for reading and writing unless a schema is given),
    block_rows, file_blocks, first_block (``true``: of each file only the first
    block), strings and binary_data (``none`` or a Zstd level), magic.
    """

    @classmethod
    def name(cls) -> str:
        return "lamina"

    def schema(self) -> T.StructType:
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(self.options["path"])
        with opened(files[0]) as stream:
            return row_type(B.opened(stream, _magic(self.options))[0])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return BinaryReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return BinaryWriter(schema, dict(self.options), overwrite)


def _system(path: str):
    """(Arrow file system, path inside it)."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def opened(path: str):
    system, own = _system(path)
    return system.open_input_stream(own)


def read_text(path: str) -> str:
    with opened(path) as stream:
        return stream.read().decode()


def write_bytes(path: str, data: bytes) -> None:
    """A file whose folder is made if need be."""
    system, own = _system(path)
    system.create_dir(own.rpartition("/")[0], recursive=True)
    with system.open_output_stream(own) as out:
        out.write(data)


def _listed(path: str, ends: str) -> list[str]:
    """Paths in the file system of a folder."""
    system, own = _system(path)
    found = system.get_file_info(fs.FileSelector(own, allow_not_found=True))
    return sorted(x.path for x in found if x.is_file and x.path.endswith(ends))


def _files(path: str) -> list[str]:
    system, own = _system(path)
    if system.get_file_info(own).is_file:
        return [path]
    head = path[: -len(own)] if path.endswith(own) else path[: path.index("://") + 3] if "://" in path else ""
    return [head + x for x in _listed(path, ".lamina")]


def _magic(options) -> bytes:
    return options["magic"].encode() if "magic" in options else B.MAGIC


def _level(options, key: str):
    value = options.get(key, "3")
    return "None" if value == "none" else {"Zstd": {"level": int(value)}}


def block_batch(schema: Schema, block: B.Block, kind: pa.Schema) -> pa.RecordBatch:
    """The rows of a block as an Arrow batch."""
    rows = B.rows_of(block)
    if schema.kind == "binary":
        rows = [{"data": rows.decode("utf-8", "replace") if schema.encoding == "utf8" else rows}] if rows else []
    elif schema.kind == "array" and schema.inner.kind != "struct":
        rows = [{"value": r} for r in rows]
    return pa.RecordBatch.from_pylist(rows, schema=kind)


class BinaryReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.wanted, self.options = schema, options

    def partitions(self):
        return [BlockFile(p) for p in _files(self.options["path"])]

    def read(self, partition):
        with opened(partition.value) as stream:
            schema, _, found = B.opened(stream, _magic(self.options))
            kind = to_arrow_schema(row_type(schema))
            for block in found:
                yield block_batch(schema, block, kind).select(self.wanted.names)
                if self.options.get("first_block") == "true":
                    break


class BinaryWriter(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool) -> None:
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex[:8]
        self.table = check(from_json(json.loads(options["schema"])) if "schema" in options else array(infer(schema)))

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        size, most = int(self.options.get("block_rows", BLOCK_ROWS)), int(self.options.get("file_blocks", FILE_BLOCKS))
        system, folder = _system(self.options["path"])
        system.create_dir(folder, recursive=True)
        context = TaskContext.get()
        message = WriterCommitMessage()
        message.paths = []
        found, rows = [], []

        def flush() -> None:
            # The attempt's own name: what a failed attempt leaves is removed at commit.
            name = f"{folder}/{context.partitionId():05d}-{self.job}-{context.taskAttemptId()}-{len(message.paths):05d}.part"
            with system.open_output_stream(name) as out:
                out.write(B.to_bytes(self.table, found, _level(self.options, "strings"), _level(self.options, "binary_data"), _magic(self.options)))
            message.paths.append(name)
            found.clear()

        for row in iterator:
            row = plain(row)
            rows.append(row if self.table.kind == "array" and self.table.inner.kind == "struct" else (row["key"], row["value"]) if self.table.kind == "map" else next(iter(row.values())))
            if len(rows) == size:
                found.append(B.block_of(self.table, rows))
                rows = []
                if len(found) == most:
                    flush()
        if rows:
            found.append(B.block_of(self.table, rows))
        if found or not message.paths:
            flush()
        return message

    def commit(self, messages) -> None:
        path = self.options["path"]
        system, _ = _system(path)
        old = _listed(path, ".lamina") if self.overwrite else []
        for m in messages:
            for part in m.paths if m is not None else ():
                system.move(part, part.removesuffix("part") + "lamina")
        for x in old:  # only when the new files are there
            system.delete_file(x)
        self.abort([])

    def abort(self, messages) -> None:
        system, _ = _system(self.options["path"])
        for left in _listed(self.options["path"], ".part"):
            if f"-{self.job}-" in left:
                system.delete_file(left)


# JSON documents {"schema": ..., "data": ...}: one file is one document.


def value_from_json(schema: Schema, doc):
    """A value of a document; its type is told by the literal, so a whole number is not a double."""
    kind = schema.kind
    if kind in ("struct", "reversed", "enum", "nested", "array"):
        if kind == "struct":
            if not isinstance(doc, dict) or list(doc) != ["struct"] or not isinstance(doc["struct"], dict):
                raise SchemaError.mismatch("Struct", "object" if isinstance(doc, dict) else type(doc).__name__)
            fields = doc["struct"]
            if len(fields) != len(schema.parts):
                raise SchemaError.mismatch(f"struct with {len(schema.parts)} fields", f"struct with {len(fields)} fields")
            for name, _ in schema.parts:  # an object has no order, so only the names count
                if name not in fields:
                    raise SchemaError.missing(name)
            return {n: value_from_json(s, fields[n]) for n, s in schema.parts}
        if kind == "reversed":
            return value_from_json(schema.inner, doc)
        if kind == "enum":
            own = doc["enum"]
            for _, t, s in schema.parts:
                if t == own["tag"]:
                    return {"tag": t, f"v_{t}": value_from_json(s, own.get("value"))}
            raise SchemaError.unsupported(f"Enum tag {own['tag']}")
        if kind == "nested":
            return rows_from_json(schema.inner, doc)
        if not isinstance(doc, list):
            raise SchemaError.mismatch("Array", type(doc).__name__)
        return [value_from_json(schema.inner, x) for x in doc]
    if isinstance(doc, bool):
        raise SchemaError.unsupported("bool")
    if kind == "unit" and doc is None:
        return None
    if kind == "int" and isinstance(doc, int) and -(1 << 63) <= doc < 1 << 63:
        return doc
    if kind == "double" and isinstance(doc, (float, str)):
        return float(doc)
    if kind == "binary" and isinstance(doc, str):
        return doc if schema.encoding == "utf8" else doc.encode()
    if kind == "binary" and isinstance(doc, list):
        return bytes(doc)
    raise SchemaError.mismatch(kind.capitalize(), type(doc).__name__)


def rows_from_json(table: Schema, data):
    if table.kind == "binary":
        if not isinstance(data, str):
            raise SchemaError.mismatch("Binary", type(data).__name__)
        return data.encode()
    if not isinstance(data, list):
        raise SchemaError.mismatch(table.kind.capitalize(), type(data).__name__)
    if table.kind == "map":
        key, value = table.parts
        return [{"key": value_from_json(key, e["key"]), "value": value_from_json(value, e["value"])} for e in data]
    return [value_from_json(table.inner, x) for x in data]


def value_to_json(schema: Schema, value):
    kind = schema.kind
    if kind == "struct":
        return {"struct": {n: value_to_json(s, value[n]) for n, s in schema.parts}}
    if kind == "array":
        return [value_to_json(schema.inner, v) for v in value]
    if kind == "enum":
        inner = next(s for _, t, s in schema.parts if t == value["tag"])
        return {"enum": {"tag": value["tag"], "value": value_to_json(inner, value.get(f"v_{value['tag']}"))}}
    if kind == "nested":
        return rows_to_json(schema.inner, value)
    if kind == "reversed":
        return value_to_json(schema.inner, value)
    if kind == "binary" and isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    if kind == "double" and (value != value or abs(value) == float("inf")):
        return str(value)
    return value


def rows_to_json(table: Schema, rows):
    if table.kind == "binary":
        return rows.decode("utf-8", "replace") if isinstance(rows, bytes) else rows
    if table.kind == "map":
        return [{"key": value_to_json(table.parts[0], r["key"]), "value": value_to_json(table.parts[1], r["value"])} for r in rows]
    return [value_to_json(table.inner, r) for r in rows]


def logical_json(schema: Schema, col: Column) -> Column:
    """A value in the shape of documents, for ``to_json``: structs and enums under a key that names them; bytes as lossy text."""
    kind = schema.kind
    if kind == "struct":
        return F.struct(F.struct(*[logical_json(s, col[n]).alias(n) for n, s in schema.parts]).alias("struct"))
    if kind == "array":
        return F.transform(col, lambda x: logical_json(schema.inner, x))
    if kind == "enum":
        value = F.coalesce(*[F.to_json(F.struct(logical_json(s, col[member(t)]).alias("x"))) for _, t, s in schema.parts if s.kind != "unit"], F.lit("{}"))
        return F.struct(F.struct(col["tag"].alias("tag"), value.alias("value")).alias("enum"))
    if kind == "nested" and schema.inner.kind == "array":
        return logical_json(schema.inner, col)
    if kind == "nested" and schema.inner.kind == "map":
        key, value = schema.inner.parts
        return F.transform(col, lambda e: F.struct(logical_json(key, e["key"]).alias("key"), logical_json(value, e["value"]).alias("value")))
    if kind == "reversed":
        return logical_json(schema.inner, col)
    return F.make_valid_utf8(col.cast("string")) if kind in ("binary", "nested") else col


# Blocks as rows: each block of a table as one striped document or one file image, made and read on executors.


def striped_documents(df: DataFrame, table: Schema, block: str, pos: str) -> DataFrame:
    """(block, doc): the striped document of each block's rows in the order of ``pos``; a block bounds what one task gathers."""
    return _by_block(df, table, block, pos, "doc string", lambda rows: json.dumps(B.block_json(B.block_of(table, rows)), ensure_ascii=False))


def rows_of_documents(docs: DataFrame, table: Schema, col: str = "doc") -> DataFrame:
    """The rows of striped documents; a malformed one fails."""
    return _unblocked(docs.select(F.col(col).cast("binary").alias("x")), table, lambda x: B.block_from_json(json.loads(x)))


def file_images(df: DataFrame, table: Schema, block: str, pos: str, strings=B.ZSTD, magic: bytes = B.MAGIC) -> DataFrame:
    """(block, image): the binary format's bytes of each block."""
    return _by_block(df, table, block, pos, "image binary", lambda rows: B.to_bytes(table, [B.block_of(table, rows)], strings, strings, magic))


def rows_of_images(images: DataFrame, table: Schema, magic: bytes = B.MAGIC) -> DataFrame:
    return _unblocked(images.select(F.col("image").alias("x")), table, lambda x: B.from_bytes(x, magic)[1][0])


def _by_block(df: DataFrame, table: Schema, block: str, pos: str, out: str, make) -> DataFrame:
    names, whole = row_type(table).names, table.kind == "array" and table.inner.kind == "struct"

    def one(part: pa.Table) -> pa.Table:
        part = part.sort_by(pos)
        rows = part.select(names).to_pylist()
        rows = rows if whole else [(r["key"], r["value"]) if table.kind == "map" else r["value"] for r in rows]
        name, kind = out.split()
        return pa.table({"block": pa.array([part[block][0].as_py()], pa.int64()), name: pa.array([make(rows)], pa.string() if kind == "string" else pa.binary())})

    return df.select(block, pos, *[n for n in names if n not in (block, pos)]).groupBy(block).applyInArrow(one, f"block long, {out}")


def _unblocked(df: DataFrame, table: Schema, read) -> DataFrame:
    kind = row_type(table)

    def each(batches):
        own = to_arrow_schema(kind)
        for batch in batches:
            for x in batch.column("x"):
                yield block_batch(table, read(x.as_py()), own)

    return df.mapInArrow(each, kind)


def work_folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; a temporary one only on a local master without that setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{found or tempfile.mkdtemp(prefix='lamina-')}/lamina-{uuid.uuid4().hex}"


def read_document(text: str) -> tuple[Schema, object]:
    doc = json.loads(text)
    for key in ("schema", "data"):
        if key not in doc:
            raise SchemaError.missing(key)
    schema = check(from_json(doc["schema"]))
    return schema, rows_from_json(schema, doc["data"])


def write_document(schema: Schema, rows) -> str:
    return json.dumps({"schema": to_json(schema), "data": rows_to_json(schema, rows)}, indent=2, ensure_ascii=False)


def frame(spark: SparkSession, schema: Schema, rows) -> DataFrame:
    """The DataFrame of a document's rows."""
    if schema.kind == "binary":
        own = rows.decode("utf-8", "replace") if schema.encoding == "utf8" and isinstance(rows, bytes) else rows
        return spark.createDataFrame([(own,)] if rows else [], row_type(schema))
    if schema.kind == "array" and schema.inner.kind != "struct":
        rows = [{"value": r} for r in rows]
    return spark.createDataFrame([_tuple(r, row_type(schema)) for r in rows], row_type(schema))


def _tuple(value, kind):
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        return tuple(_tuple(value.get(f.name), f.dataType) for f in kind.fields)
    return [_tuple(v, kind.elementType) for v in value] if isinstance(kind, T.ArrayType) and value is not None else value


def read_json_lines(spark: SparkSession, path: str, table: Schema) -> DataFrame:
    """Rows from one JSON object a line, of any size; a malformed line fails the read."""
    return spark.read.schema(row_type(table)).option("mode", "FAILFAST").json(path)


def json_column(df: DataFrame, schema: Schema, col: str) -> DataFrame:
    """``value`` parsed from a JSON text column by a schema; malformed text fails."""
    return df.withColumn("value", F.from_json(col, spark_type(schema), {"mode": "FAILFAST"}))
