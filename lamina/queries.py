"""The catalogue: every operator over the driver's tables, with the SQL that says what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions import encode as E
from .operators import defaults, extract, merge, stripe
from .operators import validate as V
from .sources.files import json_column, logical_json
from .streaming.chunks import encoded_chunks

_FOUND: dict[str, tuple[Callable, str]] = {}
LIMIT = S.DATE_LIMIT


def query(sql: str):
    def keep(f):
        _FOUND[f.__name__] = (f, sql)
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))) for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items()}


# Shapes made from the flat tables.

#: The enum of events: a double, a text, no value, an integer, a date, by the rank of event_type.
EVENT = S.enum(("number", 0, S.double()), ("props", 1, S.utf8()), ("nothing", 2, S.UNIT), ("user", 3, S.integer()), ("moment", 4, S.integer("date")))
CUSTOMER = S.struct(("c_custkey", S.integer()), ("c_name", S.utf8()), ("c_acctbal", S.double()))
_TAG_SQL = "(ascii(substr(event_type, 1, 1)) + length(event_type)) % 5"
_MS_SQL = "epoch_us(ts) // 1000"


def _millis(col: str):
    return F.expr(f"unix_micros(cast({col} as timestamp)) div 1000")


def _events(t) -> DataFrame:
    """Events with an enum of mixed tags."""
    tag = ((F.ascii(F.substring("event_type", 1, 1)) + F.length("event_type")) % 5).cast("long")
    e = t("events").withColumn("tag", tag).withColumn("ms", _millis("ts"))
    own = [
        F.when(F.col("tag") == 0, F.col("value")).alias("v_0"),
        F.when(F.col("tag") == 1, F.col("props")).alias("v_1"),
        F.lit(None).alias("v_2"),
        F.when(F.col("tag") == 3, F.col("user_id")).alias("v_3"),
        F.when(F.col("tag") == 4, F.col("ms")).alias("v_4"),
    ]
    return e.select("event_id", F.struct("tag", *own).alias("e"), stripe.at_most_one_block("event_id").alias("block"))


_EVENT_SQL = f"select event_id, {_TAG_SQL} as tag, event_id // 1000 as block, value, props, user_id, {_MS_SQL} as ms from events"
_OPEN_SQL = "select event_id, tag, case when tag=0 then value end as v_0, case when tag=1 then props end as v_1, case when tag=3 then user_id end as v_3, case when tag=4 then ms end as v_4 from x"


def _opened(df: DataFrame) -> DataFrame:
    return df.select("event_id", "e.tag", "e.v_0", "e.v_1", "e.v_3", "e.v_4")


# Sources.


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 100000")
def scan_project(t):
    return t("orders").where("o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query("select event_id // 1000 as block, count(*) as n from events group by 1")
def block_rowcount(t):
    return t("events").groupBy(stripe.at_most_one_block("event_id").alias("block")).agg(F.count("*").alias("n"))


@query("select 'array' as kind, count(*) as n from events union all select 'map', count(*) from part union all select 'binary', 1 union all select 'nothing', 0")
def row_count(t):
    named = lambda kind, df: df.select(F.lit(kind).alias("kind"), "n")
    entries = t("part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))
    data = stripe.blobs(t("region").withColumn("block", F.lit(0)), "r_name", "block", "r_regionkey").select("data")
    out = named("array", stripe.row_count(t("events"), S.array(S.integer())))
    for kind, df, table in (("map", entries, S.map_table(S.integer(), S.utf8())), ("binary", data, S.binary()), ("nothing", data.select(F.lit(b"").alias("data")), S.binary())):
        out = out.unionByName(named(kind, stripe.row_count(df, table)))
    return out


@query("""select c_custkey, '{"struct":{"c_custkey":' || c_custkey || ',"parts":[{"struct":{"name":"' || c_name || '"}}],"raw":"' || c_mktsegment || '"}}' as doc from customer""")
def json_project(t):
    schema = S.struct(("c_custkey", S.integer()), ("parts", S.array(S.struct(("name", S.utf8())))), ("raw", S.binary()))
    made = F.struct("c_custkey", F.array(F.struct(F.col("c_name").alias("name"))).alias("parts"), F.col("c_mktsegment").cast("binary").alias("raw"))
    return t("customer").select("c_custkey", F.to_json(logical_json(schema, made)).alias("doc"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_parse(t):
    parsed = json_column(t("events"), S.struct(("k", S.integer())), "props")
    return parsed.select("event_id", "value.k")


# Validation.


@query(f"select event_id, {_MS_SQL} + (event_id % 5 - 1) * 900000000000 between 0 and {LIMIT} as ok from events")
def validate_date_range(t):
    moved = _millis("ts") + (F.col("event_id") % 5 - 1) * F.lit(900000000000)
    return t("events").select("event_id", V.valid(S.integer("date"), moved).alias("ok"))


@query("select doc_id, doc_id % 3 <> 0 as ok from documents")
def validate_utf8(t):
    """Every third text ends in a byte that no text can end in."""
    raw = F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 3 == 0, F.lit(b"\xe2")).otherwise(F.lit(b"")))
    return t("documents").select("doc_id", V.valid(S.utf8(), raw).alias("ok"))


@query(f"select o_orderkey, epoch_us(o_orderdate) // 1000 + o_custkey * 1000000000 between 0 and {LIMIT} and epoch_us(o_orderdate) // 1000 between 0 and {LIMIT} as ok from orders")
def validate_array(t):
    both = F.array(_millis("o_orderdate"), _millis("o_orderdate") + F.col("o_custkey") * F.lit(1000000000))
    return t("orders").select("o_orderkey", V.valid(S.array(S.integer("date")), both).alias("ok"))


@query(f"select c_custkey, c_custkey * 5000000000 - 1000000000000 between 0 and {LIMIT} as ok from customer")
def validate_struct(t):
    schema = S.struct(("at", S.integer("date")), ("name", S.utf8()), ("balance", S.double()))
    made = t("customer").select("c_custkey", F.struct((F.col("c_custkey") * F.lit(5000000000) - F.lit(1000000000000)).alias("at"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("s"))
    V.check_shape(schema, made.schema["s"].dataType)
    return made.select("c_custkey", V.valid(schema, F.col("s")).alias("ok"))


@query(f"with x as ({_EVENT_SQL}) select event_id, tag in (0, 1, 2, 4) as ok from x")
def validate_enum(t):
    known = S.enum(*[p for p in EVENT.parts if p[1] != 3])
    return _events(t).select("event_id", V.valid(known, F.col("e")).alias("ok"))


@query(f"select count(*) as n_rows, count(*) filter (where not epoch_us(l_shipdate) // 1000 + l_orderkey * 100000000 between 0 and {LIMIT}) as n_invalid from lineitem")
def validate_table(t):
    table = S.array(S.struct(("at", S.integer("date")), ("quantity", S.double())))
    rows = t("lineitem").select((_millis("l_shipdate") + F.col("l_orderkey") * F.lit(100000000)).alias("at"), F.col("l_quantity").alias("quantity"))
    return V.validate(rows, table).select(F.col("rows").alias("n_rows"), F.col("invalid").alias("n_invalid"))


# Merging.


@query("select cast(case when p_partkey % 2 = 0 then 0 else 1 end as integer) as src, p_partkey as pos, p_name as value from part")
def merge_array_tables(t):
    p = t("part").select(F.col("p_partkey").alias("_pos"), F.col("p_name").alias("value"))
    both = merge.merge_array_tables(p.where("_pos % 2 = 0"), p.where("_pos % 2 = 1"))
    return both.select(F.col("_src").alias("src"), F.col("_pos").alias("pos"), "value")


@query("select p_partkey as key, p_retailprice as value, cast(case when p_partkey % 3 <> 0 then 0 else 1 end as integer) as src, p_partkey as pos from part where p_partkey % 3 <> 0 or p_partkey % 2 = 0")
def merge_map_tables(t):
    p = t("part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("value"), F.col("p_partkey").alias("_pos"))
    out = merge.merge_map_tables(p.where("key % 3 <> 0"), p.where("key % 2 = 0"), S.double())
    return out.select("key", "value", F.col("_src").alias("src"), F.col("_pos").alias("pos"))


@query("select p_partkey, p_size = p_size + case when p_partkey % 7 = 0 then 1 else 0 end as ok from part")
def merge_conflicts(t):
    other = F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)
    return t("part").select("p_partkey", merge.agree(S.integer(), F.col("p_size").cast("long"), other.cast("long")).alias("ok"))


@query("with x as (select p_partkey, p_retailprice / 10000 as a, p_retailprice / 10000 + (p_partkey % 5) * 1e-16 as b from part) select p_partkey, abs(a - b) < 2.220446049250313e-16 as ok, a as kept from x")
def merge_double_eps(t):
    a = F.col("p_retailprice") / 10000
    b = a + (F.col("p_partkey") % 5) * F.lit(1e-16)
    return t("part").select("p_partkey", merge.agree(S.double(), a, b).alias("ok"), a.alias("kept"))


@query("select vec_id, cast(i as bigint) as at, case when i < 64 then embedding[i + 1] else embedding[i - 63] end as value from embeddings, range(128) r(i)")
def merge_arrays(t):
    e = F.col("embedding")
    both = t("embeddings").select("vec_id", merge.merged(S.array(S.double()), e, e).alias("v"))
    return stripe.elements(both, "v", "vec_id").select("vec_id", F.col("_at").alias("at"), "value")


@query("select c_custkey, c_custkey % 5 <> 0 as ok, case when c_custkey % 5 <> 0 then c_name end as c_name, case when c_custkey % 5 <> 0 then c_acctbal / 100000 end as c_acctbal from customer")
def merge_struct(t):
    """The other side's balance differs by less than the epsilon, and every fifth name differs."""
    small = F.col("c_acctbal") / 100000
    a = F.struct("c_custkey", "c_name", small.alias("c_acctbal"))
    name = F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name"))
    b = F.struct("c_custkey", name.alias("c_name"), (small + 1e-17).alias("c_acctbal"))
    ok = merge.agree(CUSTOMER, a, b)
    merged = F.when(ok, merge.merged(CUSTOMER, a, b)).alias("s")
    return t("customer").select("c_custkey", ok.alias("ok"), merged).select("c_custkey", "ok", "s.c_name", "s.c_acctbal")


@query(f"with x as ({_EVENT_SQL}), y as ({_OPEN_SQL}) select event_id, event_id % 7 <> 0 and not (tag = 3 and event_id % 2 = 0) as ok, case when event_id % 7 <> 0 and not (tag = 3 and event_id % 2 = 0) then coalesce(v_1, v_3::varchar, v_4::varchar) end as kept from y")
def merge_enum(t):
    """Every seventh tag differs, and of even events the user."""
    e = _events(t)
    tag = F.when(F.col("event_id") % 7 == 0, (F.col("e.tag") + 1) % 5).otherwise(F.col("e.tag"))
    user = F.when(F.col("event_id") % 2 == 0, F.col("e.v_3") + 1).otherwise(F.col("e.v_3"))
    both = e.withColumn("f", F.struct(tag.alias("tag"), "e.v_0", "e.v_1", "e.v_2", user.alias("v_3"), "e.v_4"))
    ok = F.coalesce(merge.agree(EVENT, F.col("e"), F.col("f")), F.lit(False))
    out = both.select("event_id", ok.alias("ok"), F.when(ok, merge.merged(EVENT, F.col("e"), F.col("f"))).alias("m"))
    return out.select("event_id", "ok", F.coalesce("m.v_1", F.col("m.v_3").cast("string"), F.col("m.v_4").cast("string")).alias("kept"))


@query("select o_orderkey, 0::bigint as at, o_custkey as key, o_orderkey as value from orders union all select o_orderkey, 1, -1, 7 from orders union all select o_orderkey, 2, -2, o_custkey from orders")
def merge_nested(t):
    """Maps in cells, in a wrapper of reversed order: a shared key merges, new ones are appended once."""
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    custkey, orderkey = F.col("o_custkey"), F.col("o_orderkey")
    first, last = F.lit(-1).cast("long"), F.lit(-2).cast("long")
    a = F.array(entry(custkey, orderkey), entry(first, F.lit(7).cast("long")))
    b = F.array(entry(last, custkey), entry(custkey, orderkey), entry(last, custkey))
    table = S.reverse(S.nested(S.map_table(S.integer(), S.integer())))
    merged = t("orders").select("o_orderkey", F.posexplode(merge.merged(table, a, b)).alias("at", "x"))
    return merged.select("o_orderkey", F.col("at").cast("long").alias("at"), "x.key", "x.value")


# Defaults and extraction.


@query("select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '') as c_mktsegment, case when c_custkey % 3 = 0 then 0.0 else c_acctbal end as c_acctbal, cast(0 as bigint) as c_missing from customer")
def fill_defaults(t):
    schema = S.struct(("c_custkey", S.integer()), ("c_mktsegment", S.utf8()), ("c_acctbal", S.double()), ("c_missing", S.integer()))
    some = t("customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    return defaults.fill(some, schema)


@query("select c_custkey, c_name, c_acctbal from customer")
def take_struct(t):
    return extract.take_fields(t("customer").select(F.struct("c_custkey", "c_name", "c_acctbal").alias("s")), "s")


# Striping.


@query("select event_id as pos, 'double' as kind, value from events union all select event_id, 'int', user_id::double from events")
def stripe_scalar(t):
    e = t("events")
    shown = lambda kind, df: df.select(F.col("event_id").alias("pos"), F.lit(kind).alias("kind"), F.col("value").cast("double").alias("value"))
    return shown("double", stripe.scalars(e, "value", S.double(), "event_id")).unionByName(shown("int", stripe.scalars(e, "user_id", S.integer(), "event_id")))


@query("select doc_id, octet_length(encode(text)) as length from documents")
def stripe_binary_lengths(t):
    return stripe.byte_lengths(t("documents"), "text", "doc_id")


@query("select vec_id, cast(generate_subscripts(embedding, 1) - 1 as bigint) as at, unnest(embedding) as value from embeddings")
def stripe_array(t):
    return stripe.elements(t("embeddings"), "embedding", "vec_id").select("vec_id", F.col("_at").alias("at"), "value")


@query("select vec_id, cast(len(embedding) as bigint) as length from embeddings")
def stripe_array_lengths(t):
    return stripe.lengths(t("embeddings"), "embedding", "vec_id")


@query("select c_custkey, c_acctbal, c_name from customer")
def stripe_struct(t):
    s = t("customer").select(F.col("c_custkey"), F.struct("c_name", "c_mktsegment", "c_acctbal").alias("s"))
    return stripe.struct_columns(s, "s", S.struct(("c_acctbal", S.double()), ("c_name", S.utf8())), "c_custkey")


@query(f"with x as ({_EVENT_SQL}) select event_id, block, tag, row_number() over (partition by block, tag order by event_id) as nth from x")
def stripe_enum(t):
    tags, _ = stripe.enum_columns(_events(t), "e", EVENT, "event_id", "block")
    return tags.select("event_id", "block", "tag", F.col("_nth").alias("nth"))


@query("select l_orderkey, count(*) over (partition by l_orderkey) as length, l_linenumber, l_partkey from lineitem")
def stripe_nested(t):
    orders = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("rows"))
    flat = stripe.elements(orders, "rows", "l_orderkey").select("l_orderkey", "value.*")
    return stripe.lengths(orders, "rows", "l_orderkey").join(flat, "l_orderkey")


@query("select doc_id, coalesce(sum(octet_length(encode(text))) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as at from documents")
def unstripe_offsets_whole(t):
    sizes = t("documents").select("doc_id", F.octet_length("text").cast("long").alias("length"))
    return stripe.offsets(sizes, "length", "doc_id").select("doc_id", F.col("_offset").alias("at"))


@query("select doc_id, coalesce(sum(octet_length(encode(text))) over (partition by doc_id // 100 order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as at from documents")
def unstripe_offsets(t):
    docs = t("documents").withColumn("block", stripe.at_most_one_block("doc_id", 100))
    sizes = docs.select("doc_id", "block", F.octet_length("text").cast("long").alias("length"))
    return stripe.offsets(sizes, "length", "doc_id", "block").select("doc_id", F.col("_offset").alias("at"))


@query("select vec_id, cast(generate_subscripts(embedding, 1) - 1 as bigint) as at, unnest(embedding) as value from embeddings union all select -1 - vec_id, -1, null from embeddings")
def unstripe_array(t):
    """All vectors whole, and beside each an empty array under a negative number."""
    e = t("embeddings").select("vec_id", "embedding")
    both = e.unionByName(e.select((-1 - F.col("vec_id")).alias("vec_id"), F.array().cast("array<float>").alias("embedding")))
    back = stripe.array_rows(stripe.lengths(both, "embedding", "vec_id"), stripe.elements(both, "embedding", "vec_id"), "v", "vec_id")
    return back.select("vec_id", F.posexplode_outer("v").alias("at", "value")).select("vec_id", F.coalesce("at", F.lit(-1)).cast("long").alias("at"), "value")


@query("select p_partkey, p_name from part")
def unstripe_binary(t):
    p = t("part").withColumn("block", stripe.at_most_one_block("p_partkey", 500))
    sizes = p.select("block", "p_partkey", F.octet_length("p_name").cast("long").alias("length"))
    back = stripe.bytes_rows(sizes, stripe.blobs(p, "p_name", "block", "p_partkey"), "p_name", "block", "p_partkey")
    return back.select("p_partkey", F.col("p_name").cast("string").alias("p_name"))


@query("select p_partkey as pos, p_brand as key, p_retailprice as value from part")
def zip_map(t):
    p = t("part")
    return stripe.map_rows(p.select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("value")), p.select(F.col("p_partkey").alias("pos"), F.col("p_retailprice").alias("value")), "pos")


@query("select c_custkey, c_name, c_acctbal from customer")
def roundtrip_struct(t):
    s = t("customer").select(F.col("c_custkey").alias("pos"), F.struct("c_custkey", "c_name", "c_acctbal").alias("s"))
    leaves = stripe.struct_columns(s, "s", CUSTOMER, "pos")
    return leaves.select(F.struct("c_custkey", "c_name", "c_acctbal").alias("s")).select("s.*")


@query(f"with x as ({_EVENT_SQL}) {_OPEN_SQL}")
def roundtrip_enum(t):
    tags, parts = stripe.enum_columns(_events(t), "e", EVENT, "event_id", "block")
    return _opened(stripe.enum_rows(tags, parts, EVENT, "e", "event_id", "block"))


# Codecs.

_MIDDLE = "with r as (select l_suppkey, l_orderkey as x, row_number() over (partition by l_suppkey order by l_orderkey) as r, count(*) over (partition by l_suppkey) as n from lineitem), m as (select l_suppkey, max(n) as n, min(x) as a, max(x) as b from r where r = (n + 1) // 2 or r = n // 2 + 1 group by 1), d as (select l_suppkey, n, a + (b - a) // 2 as mid from m)"
_ZIGZAG = "case when d >= 0 then 2 * d else -2 * d - 1 end"


def _keys(t) -> DataFrame:
    return t("lineitem").select("l_suppkey", "l_orderkey")


@query(f"{_MIDDLE} select l_suppkey, n, mid from d")
def for_midpoint(t):
    return E.midpoints(_keys(t), ["l_suppkey"], "l_orderkey")


_FAR = "(case when event_id % 2 = 0 then 1 else -1 end) * 9000000000000000000 + event_id"
_WRAP = "((({0}) + 9223372036854775808::hugeint) % 18446744073709551616::hugeint + 18446744073709551616::hugeint) % 18446744073709551616::hugeint - 9223372036854775808::hugeint"
_FAR_SQL = f"""with e as (select event_id, event_id // 1000 as block, ({_FAR})::hugeint as x from events),
 r as (select *, row_number() over (partition by block order by x) as r, count(*) over (partition by block) as n from e),
 m as (select block, min(x) as a, max(x) as b from r where r = (n + 1) // 2 or r = n // 2 + 1 group by 1),
 g as (select block, a, {_WRAP.format("b - a")} as g from m),
 h as (select block, {_WRAP.format("a + case when g < 0 then -((-g) // 2) else g // 2 end")} as mid from g)"""


def _far(t) -> DataFrame:
    sign = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    return t("events").select("event_id", stripe.at_most_one_block("event_id").alias("block"), (sign * F.lit(9000000000000000000) + F.col("event_id")).alias("x"))


@query(f"{_FAR_SQL} select event_id, mid::bigint as mid, ({_WRAP.format('x - mid')})::bigint as delta from e join h using (block)")
def for_deltas(t):
    return E.deltas(_far(t), ["block"], "x").select("event_id", "mid", "delta")


@query(f"select event_id, ({_FAR})::bigint as x from events")
def for_roundtrip(t):
    return E.deltas(_far(t), ["block"], "x").select("event_id", E.plus(F.col("mid"), F.col("delta")).alias("x"))


@query(f"with x as (select event_id, event_id * 7919 - 3000000 as d from events) select event_id, {_ZIGZAG} as z from x")
def zigzag(t):
    return t("events").select("event_id", E.zigzag(F.col("event_id") * 7919 - 3000000).alias("z"))


@query("select event_id, event_id * 7919 - 3000000 as x from events")
def zigzag_roundtrip(t):
    return t("events").select("event_id", E.unzigzag(E.zigzag(F.col("event_id") * 7919 - 3000000)).alias("x"))


@query(f"{_MIDDLE}, z as (select l_suppkey, l_orderkey - mid as d from lineitem join d using (l_suppkey)) select l_suppkey, max(length(bin({_ZIGZAG})))::bigint as bits from z group by 1")
def bit_width(t):
    z = E.deltas(_keys(t), ["l_suppkey"], "l_orderkey").select("l_suppkey", E.zigzag(F.col("delta")).alias("z"))
    return z.groupBy("l_suppkey").agg(E.width(F.bit_or("z")).alias("bits"))


_SIZE = f"{_MIDDLE}, z as (select l_suppkey, n, mid, l_orderkey - mid as d from lineitem join d using (l_suppkey)), w as (select l_suppkey, n, mid, max(length(bin({_ZIGZAG}))) as bits from z group by all)"


@query(f"{_SIZE} select l_suppkey, n, mid, bits::bigint as bits, (case when bits >= 32 then 13 + 8 * n else 13 + (n * bits + 7) // 8 end)::bigint as n_bytes from w")
def encoded_size(t):
    z = E.deltas(_keys(t), ["l_suppkey"], "l_orderkey").select("l_suppkey", "n", "mid", E.zigzag(F.col("delta")).alias("z"))
    frames = z.groupBy("l_suppkey", "n", "mid").agg(E.width(F.bit_or("z")).alias("bits"))
    return frames.select("l_suppkey", "n", "mid", "bits", E.encoded_size(F.col("n"), F.col("bits")).alias("n_bytes"))


@query(
    "with e as (select event_id // 1000 as chunk, user_id as x from events), r as (select *, row_number() over (partition by chunk order by x) as r, count(*) over (partition by chunk) as n from e), "
    "m as (select chunk, max(n) as n, min(x) as a, max(x) as b from r where r = (n + 1) // 2 or r = n // 2 + 1 group by 1), "
    f"z as (select chunk, n, x - (a + (b - a) // 2) as d from e join m using (chunk)), w as (select chunk, n, max(length(bin({_ZIGZAG}))) as bits from z group by all) "
    "select chunk, n, (13 + case when bits >= 32 then 8 * n else (n * bits + 7) // 8 end)::bigint as n_bytes from w"
)
def packed_bytes(t):
    """The codec's real bytes, in chunks of 1000 rows; the oracle knows their number."""
    return encoded_chunks(t("events"), "event_id", "user_id").select("chunk", "n", "n_bytes")


@query("select event_id, user_id from events")
def int_codec_roundtrip(t):
    chunks = encoded_chunks(t("events"), "event_id", "user_id")
    back = chunks.select("chunk", F.posexplode(E.decompressed("data", "n")).alias("at", "user_id"))
    placed = t("events").select("event_id", stripe.at_most_one_block("event_id").alias("chunk"))
    return stripe.dense(placed, "chunk", "event_id").join(back.select("chunk", (F.col("at") + 1).cast("long").alias("_nth"), "user_id"), ["chunk", "_nth"]).select("event_id", "user_id")


@query("select event_id, value from events")
def double_bits_roundtrip(t):
    return t("events").select("event_id", E.bits_double(E.double_bits("value")).alias("value"))


@query("select doc_id, octet_length(encode(text)) as length, text from documents")
def zstd_roundtrip(t):
    d = t("documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    packed = d.select("doc_id", F.octet_length("raw").cast("long").alias("length"), E.zstd("raw").alias("z"))
    return packed.select("doc_id", "length", E.unzstd("z", "length").cast("string").alias("text"))


from . import queries_storage  # noqa: E402, F401  registers its own
