"""Schemas, blocks, codecs, merging and conversions on small fixtures."""

import json
import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina import cli
from lamina import schema as S
from lamina.errors import BinaryError, ConversionError, LogicalError, SchemaError, StripedError
from lamina.functions import encode as E
from lamina.operators import defaults, extract, merge, stripe, validate
from lamina.plans import convert as C
from lamina.sources import blocks as B
from lamina.sources import files

L = S.DATE_LIMIT
RESULT = S.enum(("success", 0, S.utf8()), ("error", 1, S.integer()))


def schemas(depth=3):
    leaf = st.sampled_from([S.UNIT, S.integer(), S.integer("date"), S.double("deny"), S.utf8(), S.binary()])
    if not depth:
        return leaf
    inner = schemas(depth - 1)
    table = st.one_of(inner.map(S.array), st.tuples(inner, inner).map(lambda p: S.map_table(*p)), st.just(S.Schema("binary", "binary")))
    return st.one_of(
        leaf,
        inner.map(S.array),
        inner.map(S.reverse),
        table.map(S.nested),
        st.lists(inner, min_size=1, max_size=5).map(lambda xs: S.struct(*((f"f{i}", x) for i, x in enumerate(xs)))),
        st.lists(inner, min_size=1, max_size=3).map(lambda xs: S.enum(*((f"n{i % 2}", i * 7, x) for i, x in enumerate(xs)))),
    )


def values(s):
    k = s.kind
    if k == "unit":
        return st.none()
    if k == "int":
        return st.integers(0, L) if s.encoding == "date" else st.integers(-(1 << 63), (1 << 63) - 1)
    if k == "double":
        return st.floats(allow_nan=False)
    if k == "binary":
        return st.text(max_size=6) if s.encoding == "utf8" else st.binary(max_size=6)
    if k == "array":
        return st.lists(values(s.inner), max_size=3)
    if k == "struct":
        return st.fixed_dictionaries({n: values(x) for n, x in s.parts})
    if k == "enum":
        blank = {S.member(t): None for _, t, _ in s.parts}
        return st.one_of(*[values(x).map(lambda v, t=t: {"tag": t, **blank, S.member(t): v}) for _, t, x in s.parts])
    if k == "nested":
        t = s.inner
        if t.kind == "map":
            return st.lists(st.fixed_dictionaries({"key": values(t.parts[0]), "value": values(t.parts[1])}), max_size=3)
        return st.binary(max_size=5) if t.kind == "binary" else st.lists(values(t.inner), max_size=3)
    return values(s.inner)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_blocks_come_back_through_columns_bytes_and_documents(data):
    element = data.draw(schemas())
    rows = data.draw(st.lists(values(element), max_size=6))
    table = S.array(element)
    block = B.block_of(table, rows)
    assert block.rows == len(rows) and B.rows_of(block) == rows
    for codec in ("None", B.ZSTD):
        schema, (again,) = B.from_bytes(B.to_bytes(table, [block], codec, codec))
        assert schema == table and B.rows_of(again) == rows
    assert B.rows_of(B.block_from_json(json.loads(json.dumps(B.block_json(block))))) == rows
    assert S.from_json(json.loads(json.dumps(S.to_json(table)))) == table
    assert S.from_header(json.loads(json.dumps(S.to_header(table)))) == table


def test_schema_checks():
    for bad, text in ((S.enum(), "Empty enum"), (S.array(S.struct()), "Empty struct"), (S.struct(("a", S.UNIT), ("a", S.UNIT)), "Duplicate field name: a"), (S.enum(("a", 1, S.UNIT), ("b", 1, S.UNIT)), "Duplicate enum tag: 1")):
        with pytest.raises(SchemaError, match=text):
            S.check(bad)
    for bad in ({"type": "bool"}, {"type": "int", "encoding": "utf8"}, {"type": "binary", "encoding": "date"}, {"type": "int", "default": "maybe"}):
        with pytest.raises(SchemaError):
            S.from_json(bad)
    for kind, doc in ((S.UNIT, 5), (S.integer(), True), (S.double(), 42), (S.struct(("a", S.UNIT)), {"a": None})):
        with pytest.raises(SchemaError):
            files.value_from_json(kind, doc)
    with pytest.raises(SchemaError):
        S.from_json({"type": "bool"})
    assert S.from_json({"type": "complex", "fields": [{"name": "a", "schema": {"type": "int"}}]}) == S.struct(("a", S.integer()))


def test_header_dialect_is_externally_tagged():
    assert S.to_header(S.array(S.integer())) == {"Array": {"default": "Allow", "element": {"Int": {"default": "Allow", "encoding": {"Int": "Int"}}}}}


def test_mixed_enum_roundtrip_and_errors():
    rows = [{"tag": 0, "v_0": "OK", "v_1": None}, {"tag": 1, "v_0": None, "v_1": 404}, {"tag": 0, "v_0": "", "v_1": None}]
    col = B.from_values(RESULT, rows)
    assert col.values == [0, 1, 0] and col.parts[1][2].values == [404]
    assert B.to_values(col) == rows
    with pytest.raises(SchemaError, match="150"):
        B.from_values(RESULT, [{"tag": 150}])
    short = B.Column("binary", "allow", "binary", lengths=[1], data=b"ab")
    with pytest.raises(StripedError, match="length mismatch"):
        B.to_values(short)
    keys, vals = B.from_values(S.integer(), [1, 2]), B.from_values(S.integer(), [1])
    with pytest.raises(StripedError, match="expected 2, got 1"):
        B.rows_of(B.Block("map", columns=[keys, vals]))
    with pytest.raises(SchemaError):
        B.from_values(S.double(), [42])
    with pytest.raises(SchemaError):
        B.column_from_json({"type": "int", "values": ["x"]})


def test_binary_file_errors():
    good = B.to_bytes(S.array(S.integer()), [B.block_of(S.array(S.integer()), [1, 2, 3])])
    with pytest.raises(BinaryError, match="magic"):
        B.from_bytes(b"x" * 16 + good[16:])
    for cut in (20, len(good) - 1):
        with pytest.raises(BinaryError):
            B.from_bytes(good[:cut])
    assert B.from_bytes(b"0123456789abcdef" + good[16:], b"0123456789abcdef")[0] == S.array(S.integer())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), max_size=40))
def test_int_codec_roundtrip(xs):
    data = E.compress_ints(xs)
    assert E.decompress_ints(data, len(xs)).tolist() == xs
    if xs:
        with pytest.raises(BinaryError):
            E.decompress_ints(data[:-1], len(xs))


@pytest.mark.parametrize("xs", [[4611686018427387904], [0, -1152921504606846976], [5823061857575085472, -3400310179279690336, -3400310179279690336], [0, -1152921504606846975]])
def test_int_codec_at_the_edges(xs):
    assert E.decompress_ints(E.compress_ints(xs), len(xs)).tolist() == xs


def test_encoded_sizes():
    week = [L + 3600000 * i for i in range(168)]
    assert len(E.compress_ints(week)) == 643
    for n, size in ((100, 101), (1000, 1263), (10000, 17513)):
        assert len(E.compress_ints(range(n))) == size
    assert struct.unpack_from("<q", E.compress_ints([100, 102, 98, 101, 99, 103, 97]))[0] == 100
    assert E.pack(np.array([0, 1, 2, 15, 255, 1000], np.uint64))[0] == 10


def test_bytes_codec_takes_any_ratio():
    data = b"\0" * 1_000_000
    assert E.decompress_bytes(E.compress_bytes(data), len(data)) == data
    with pytest.raises(BinaryError):
        E.decompress_bytes(E.compress_bytes(data), len(data) - 1)
    assert E.decompress_bytes(E.compress_bytes(b"", None), 0, None) == b""


def test_validate_boundaries(spark):
    df = spark.createDataFrame([(x,) for x in (0, L - 1, L, -1, L + 1, 5000000000000)], "d long")
    ok = [r[0] for r in df.select(validate.valid(S.integer("date"), F.col("d"))).collect()]
    assert ok == [True, True, True, False, False, False]
    assert all(r[0] for r in df.select(validate.valid(S.integer("time_milliseconds"), F.col("d"))).collect())
    bad = spark.createDataFrame([(bytearray(b"\xff\xfe\xfd"),), (bytearray(b"ok"),)], "b binary")
    assert [r[0] for r in bad.select(validate.valid(S.utf8(), F.col("b"))).collect()] == [False, True]
    with pytest.raises(Exception, match="does not satisfy"):
        validate.strict(df, S.array(S.struct(("d", S.integer("date"))))).collect()
    with pytest.raises(SchemaError, match="Missing required field: e"):
        validate.check_shape(S.struct(("e", S.integer())), df.schema)


def test_merge_of_tables_and_values(spark):
    left = spark.createDataFrame([(1, 10, 0), (2, 20, 1), (2, 21, 2)], "key long, value long, _pos long")
    right = spark.createDataFrame([(2, 20, 0), (3, 30, 1), (3, 30, 2)], "key long, value long, _pos long")
    got = merge.merge_map_tables(left, right, S.integer()).orderBy("_src", "_pos").collect()
    assert [(r.key, r.value) for r in got] == [(1, 10), (2, 20), (2, 21), (3, 30)]
    null = spark.createDataFrame([(1, None, 0), (3, None, 1), (3, None, 2)], left.schema)
    with pytest.raises(Exception, match="Invalid value"):
        merge.merge_map_tables(left, null, S.integer()).collect()
    assert [(r.key, r.value) for r in merge.merge_map_tables(null.where("key = 3"), null.where("key = 3"), S.integer()).collect()] == [(3, None), (3, None)]
    with pytest.raises(Exception, match="Invalid value"):
        merge.merge_map_tables(null, left, S.integer()).collect()
    with pytest.raises(Exception, match="Invalid value"):
        merge.merge_map_tables(left, spark.createDataFrame([(1, 11, 0)], left.schema), S.integer()).collect()
    inf, nan = float("inf"), float("nan")
    pairs = spark.createDataFrame([(1.0, 1.0 + 1e-16), (1.0, 1.1), (inf, inf), (nan, nan)], "a double, b double")
    assert [r[0] for r in pairs.select(merge.agree(S.double(), F.col("a"), F.col("b"))).collect()] == [True, False, False, False]
    cells = spark.createDataFrame([([(1, [1]), (2, [2])], [(2, [3]), (4, [4]), (4, [5])])], "a array<struct<key:long,value:array<long>>>, b array<struct<key:long,value:array<long>>>")
    table = S.nested(S.map_table(S.integer(), S.array(S.integer())))
    merged = cells.select(merge.merged(table, F.col("a"), F.col("b")).alias("m")).first().m
    assert [(e.key, e.value) for e in merged] == [(1, [1]), (2, [2, 3]), (4, [4, 5])]
    enums = spark.createDataFrame([((0, "x", None), (1, None, 5))], "a struct<tag:long,v_0:string,v_1:long>, b struct<tag:long,v_0:string,v_1:long>")
    with pytest.raises(Exception, match="Structure mismatch"):
        enums.select(merge.merged(RESULT, F.col("a"), F.col("b"))).collect()
    one, two = (spark.createDataFrame([(bytearray(x),)], "data binary") for x in (b"a", b"b"))
    assert merge.merge_binary_tables(one, one).first().data == b"a"
    with pytest.raises(Exception, match="binary tables differ"):
        merge.merge_binary_tables(one, two).collect()
    with pytest.raises(Exception, match="one row"):
        merge.merge_binary_tables(one.union(one), one).collect()


def test_defaults(spark):
    s = S.struct(("i", S.integer()), ("d", S.double()), ("t", S.utf8()), ("a", S.array(S.integer())), ("e", RESULT), ("n", S.nested(S.map_table(S.integer(), S.double()))))
    row = spark.range(1).select(defaults.default_value(s).alias("s")).first().s
    assert (row.i, row.d, row.t, row.a, row.e.tag, row.e.v_0, row.e.v_1, row.n) == (0, 0.0, "", [], 0, "", None, [])
    assert defaults.default_table(spark, S.array(s)).count() == 0


def test_stripe_errors_and_empty_arrays(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, []), (2, [3])], "_pos long, a array<long>")
    back = stripe.array_rows(stripe.lengths(df, "a"), stripe.elements(df, "a"), "a")
    assert {r._pos: r.a for r in back.collect()} == {0: [1, 2], 1: [], 2: [3]}
    wrong = stripe.lengths(df, "a").withColumn("length", F.col("length") + 1)
    with pytest.raises(Exception, match="array length mismatch"):
        stripe.array_rows(wrong, stripe.elements(df, "a"), "a").collect()
    with pytest.raises(Exception, match="position 2 has no value"):
        stripe.map_rows(df.select("_pos", F.lit(1).alias("value")), df.where("_pos < 2").select("_pos", F.lit(1).alias("value"))).collect()
    with pytest.raises(Exception, match="position [23] has no"):
        stripe.map_rows(df.select("_pos", F.lit(1).alias("value")), df.select(F.when(F.col("_pos") == 2, 3).otherwise(F.col("_pos")).alias("_pos"), F.lit(1).alias("value"))).collect()


def test_offsets_of_a_whole_table(spark):
    sizes = [(i * 7 % 501 * 3 - 40, i % 11) for i in range(501)]
    got = stripe.offsets(spark.createDataFrame(sizes, "_pos long, length long").repartition(3)).collect()
    at, want = 0, {}
    for p, n in sorted(sizes):
        want[p], at = at, at + n
    assert {r._pos: r._offset for r in got} == want
    blocks = spark.createDataFrame([(9007199254740999,), (-1,), (999,), (1000,)], "x long").select(stripe.at_most_one_block("x"), stripe.at_most_one_block("x", 1)).collect()
    assert [tuple(r) for r in blocks] == [(9007199254740, 9007199254740999), (-1, -1), (0, 999), (1, 1000)]


def test_enum_columns_that_do_not_match(spark):
    df = spark.createDataFrame([(0, (0, "a", None)), (1, (1, None, 5)), (2, (0, None, None))], "_pos long, e struct<tag:long,v_0:string,v_1:long>")
    tags, parts = stripe.enum_columns(df, "e", RESULT)
    back = stripe.enum_rows(tags, parts, RESULT, "e")
    assert sorted((r._pos, tuple(r.e)) for r in back.collect()) == [(0, (0, "a", None)), (1, (1, None, 5)), (2, (0, None, None))]
    for wrong in ({**parts, 0: parts[0].where("_nth = 1")}, {**parts, 1: parts[1].unionByName(parts[1].withColumn("_nth", F.lit(2).cast("long")))}):
        with pytest.raises(Exception, match="variant length mismatch"):
            stripe.enum_rows(tags, wrong, RESULT, "e").collect()


def test_wrapping_arithmetic_and_bits_of_nulls(spark):
    edge = [0, 1, -1, 2**63 - 1, -(2**63), 2**32, -(2**32) - 1, 4611686018427387904]
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    df = spark.createDataFrame([(a, b) for a in edge for b in edge], "a long, b long")
    for r in df.select("a", "b", E.minus(F.col("a"), F.col("b")).alias("m"), E.plus(F.col("a"), F.col("b")).alias("p")).collect():
        assert (r.m, r.p) == (wrap(r.a - r.b), wrap(r.a + r.b))
    odd = spark.createDataFrame([(None,), (float("nan"),), (-0.0,), (1.5,)], "x double")
    back = odd.select("x", E.bits_double(E.double_bits("x")).alias("y")).collect()
    assert [repr(r.x) for r in back] == [repr(r.y) for r in back]
    assert [r[0] for r in spark.createDataFrame([(None,), ([1],)], "x array<long>").select(E.decompressed(E.compressed("x"), F.size("x"))).collect()] == [None, [1]]


def test_data_source(spark, tmp_path):
    spark.dataSource.register(files.BinarySource)
    path = str(tmp_path / "t")
    schema = S.array(S.struct(("id", S.integer("date", "deny")), ("tags", S.array(S.utf8())), ("x", S.double())))
    rows = [(i, [f"t{j}" for j in range(i % 3)], i / 7) for i in range(2500)]
    df = spark.createDataFrame(rows, "id long, tags array<string>, x double").repartition(3)
    df.write.format("lamina").option("path", path).option("schema", json.dumps(S.to_json(schema))).mode("append").save()
    back = spark.read.format("lamina").option("path", path).load()
    assert sorted(map(tuple, back.collect())) == rows
    assert files.table_schema(back).inner.parts[0][1] == S.integer("date", "deny")
    small = {"path": f"file://{path}2", "schema": json.dumps(S.to_json(schema)), "block_rows": "100", "file_blocks": "3"}
    df.coalesce(1).write.format("lamina").options(**small).mode("append").save()
    again = spark.read.format("lamina").option("path", small["path"])
    assert sorted(map(tuple, again.load().collect())) == rows and again.load().rdd.getNumPartitions() == 9
    assert again.option("first_block", "true").load().count() == 9 * 100
    df.limit(5).write.format("lamina").option("path", path).mode("overwrite").save()
    assert spark.read.format("lamina").option("path", path).load().count() == 5


def test_extractors(spark):
    df = spark.createDataFrame([(1, 1.5, "t", [1], (2, "u"))], "i long, d double, b string, a array<long>, s struct<x:long,y:string>")
    for col, kind in (("i", "int"), ("d", "double"), ("b", "binary"), ("a", "array"), ("s", "struct")):
        assert df.select(extract.take(df, col, kind)).columns == [col]
        with pytest.raises(LogicalError, match="field 'value'"):
            extract.take(df, col, "array" if kind != "array" else "int")
    assert tuple(extract.take_fields(df, "s").first()) == (2, "u")
    e = spark.createDataFrame([((1, None, 5),)], "e struct<tag:long,v_0:string,v_1:long>")
    assert e.select(extract.take_member(RESULT, F.col("e"), "int")).first()[0] == 5
    with pytest.raises(Exception, match="expected binary, got tag 1"):
        e.select(extract.take_member(RESULT, F.col("e"), "binary")).collect()
    kv = spark.createDataFrame([(1, 2)], "key long, value long")
    assert extract.take_table(kv, "map") is kv
    with pytest.raises(LogicalError, match="field 'table'"):
        extract.take_table(df, "binary")


def test_native_store_keeps_the_schema(spark, tmp_path):
    schema = S.array(S.struct(("at", S.integer("time_seconds")), ("raw", S.binary())))
    df = spark.createDataFrame([(1, bytearray(b"x"))], S.row_type(schema))
    files.write_table(df, str(tmp_path / "p"))
    assert files.table_schema(files.read_table(spark, str(tmp_path / "p"))) == schema


def test_conversions_and_command_line(spark, tmp_path, capsys):
    people, numbers = C.examples(str(tmp_path))
    out = {k: str(tmp_path / f"p.{k}") for k in ("logical", "striped", "binary", "json")}
    assert cli.main(["convert", "-i", people, "-o", out["logical"], "--to", "logical"], spark) == 0
    assert cli.main(["convert", "-i", out["logical"], "-o", out["striped"], "--from", "logical", "--to", "striped"], spark) == 0
    assert cli.main(["convert", "-i", out["striped"], "-o", out["binary"], "--from", "striped", "--to", "binary"], spark) == 0
    assert cli.main(["convert", "-i", out["binary"], "-o", out["json"], "--from", "binary", "--to", "json"], spark) == 0
    with open(people) as a, open(out["json"]) as b:
        assert json.load(a) == json.load(b)
    for path, rows in ((people, 4), (numbers, 12), (out["binary"], 4), (out["striped"], 4)):
        got = C.info(spark, path)
        assert got["rows"] == rows and got["valid"]
    assert cli.main(["convert", "-i", people, "-o", out["json"], "--from", "striped", "--to", "json"], spark) == 1
    only = tmp_path / "schema.json"
    only.write_text(json.dumps(S.to_json(C.PEOPLE)))
    capsys.readouterr()
    assert cli.main(["validate", "-d", people, "-s", str(only)], spark) == 0
    assert "Validation: PASS" in capsys.readouterr().out
    for data, reason in (('[{"id": 1, "name": "a", "age": 2}]', "Struct"), ('[{"struct": {"id": 1, "name": "a", "age": 2, "x": 0}}]', "4 fields"), ('[{"struct": {"id": 1, "name": "a", "aged": 2}}]', "field: age"), ('[{"struct": {"id": 1.5, "name": "a", "age": 2}}]', "Int")):
        wrong = tmp_path / "wrong.json"
        wrong.write_text('{"schema": {}, "data": ' + data + "}")
        got = C.validate_files(spark, str(wrong), str(only))
        assert not got["valid"] and reason in got["reason"]
    late = tmp_path / "late.json"
    late.write_text(files.write_document(S.array(S.struct(("t", S.integer("date")))), [{"t": L + 1}]))
    with pytest.raises(ConversionError, match="1 of 1"):
        C.convert(spark, str(late), out["logical"], "json", "logical")
    assert C.convert(spark, str(late), out["binary"], "json", "binary")
    assert not C.info(spark, out["binary"])["valid"]


@pytest.mark.parametrize("n", [0, 1000, 1001, 2500])
def test_a_converted_document_is_one_block(spark, tmp_path, n):
    spark.dataSource.register(files.BinarySource)
    entries = [{"key": i, "value": f"v{i}"} for i in range(n)]
    for table, rows in ((S.array(S.struct(("id", S.integer()), ("name", S.utf8()))), [{"id": i, "name": f"n{i}"} for i in range(n)]), (S.map_table(S.integer(), S.utf8()), entries)):
        at, binary, back = (str(tmp_path / f"{table.kind}.{k}") for k in ("json", "lamina", "back"))
        files.write_bytes(at, files.write_document(table, rows).encode())
        C.convert(spark, at, binary, "json", "binary")
        got = C.info(spark, binary)
        assert (got["rows"], got["blocks"]) == (n, 1)
        C.convert(spark, binary, back, "binary", "json")
        assert files.read_text(back) == files.read_text(at)
        assert sorted(map(tuple, spark.read.format("lamina").option("path", binary).load().collect())) == sorted(tuple(r.values()) for r in rows)


def test_metrics_file_is_small(spark):
    rows = [{"timestamp": L - 86400000 + 60000 * i, "metric_name": f"metric_{i % 10:03d}", "value": math.fmod(0.1 * i, 100)} for i in range(1000)]
    table = S.array(S.struct(("timestamp", S.integer("date", "deny")), ("metric_name", S.utf8()), ("value", S.double())))
    assert 26 * 1000 / len(B.to_bytes(table, [B.block_of(table, rows)])) > 1.5


def test_stream_of_chunks(spark, tmp_path):
    from lamina.streaming.chunks import stream_chunks

    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    df = spark.range(2500).selectExpr("id", "id * 1000 as x")
    df.write.parquet(src)
    stream_chunks(spark, src, df.schema, out, check, "id", "x").awaitTermination()
    got = spark.read.parquet(out).select("chunk", "n", E.decompressed("data", "n").alias("xs")).collect()
    assert sorted(x for r in got for x in r.xs) == [i * 1000 for i in range(2500)]
