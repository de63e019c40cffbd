"""Every registered query against its SQL, on the small tables."""

import glob
import os

import duckdb
import pytest

from lamina import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "float": "FLOAT", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = core.queries()[name](spark, SF)
    oracle = duck.sql(core.oracle_sql()[name])
    assert sorted((f.name, TYPES[f.dataType.simpleString()]) for f in df.schema.fields) == sorted(zip(oracle.columns, map(str, oracle.types), strict=True))
    own = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    assert own == sorted(repr([dict(zip(oracle.columns, r, strict=True))[c] for c in sorted(df.columns)]) for r in oracle.fetchall())


def test_file_info_equals_its_sql_beyond_a_thousand_suppliers(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"create table supplier as select s_suppkey + 1000 * i as s_suppkey, s_name from '{SF}/supplier.parquet', range(250) r(i)")
    con.sql(f"copy supplier to '{tmp_path}/supplier.parquet' (format parquet)")
    assert con.sql("select count(*) from supplier").fetchall() == [(2500,)]
    oracle = con.sql(core.oracle_sql()["file_info"])
    assert sorted(map(tuple, core.queries()["file_info"](spark, str(tmp_path)).select(*oracle.columns).collect())) == sorted(oracle.fetchall())


def test_entry_points_import():
    import __spark_entry__ as e

    assert set(core.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
