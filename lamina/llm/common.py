"""Helpers that the corpus operators share: Python stages, shared tables, components."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROOT = str(Path(__file__).resolve().parents[2])
_LOCAL: list[str] = []
#: The module whose function this worker ran last.
_AT: list[str] = []

#: Spark's own setting to delete the shuffle files of a query as soon as it has ended, not when the driver's heap is next collected.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remote(target: str, *args) -> Callable:
    """A ``mapInArrow`` function that calls ``module:function(batches, *args)``.

    Only the name and ``args`` travel, so what a module caches (a tokenizer, a
    word cache) lives as long as the Python worker works for that module and
    not just for one task.
    """
    module, name = target.split(":")
    root = ROOT

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        importlib.import_module("lamina.llm.common").turn_to(module)
        found = getattr(importlib.import_module(module), name)(batches, *args)
        # A function of a group returns its table at once.
        return importlib.import_module("lamina.llm.common").then_give_back(found) if hasattr(found, "__next__") else found

    return run


def turn_to(module: str) -> None:
    """Close what the worker opened (``_OPEN``) for another module: workers outlive stages, and their tokenizers would stay beside the next one."""
    if _AT and _AT[0] != module:
        for name, other in list(sys.modules.items()):
            if name.startswith("lamina.llm."):
                getattr(other, "_OPEN", {}).clear()
        give_back()
    _AT[:] = [module]


def then_give_back(found: Iterator) -> Iterator:
    try:
        yield from found
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system: idle Python workers stay beside an executor's JVM while it sorts and joins."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows of the driver as a table.

    They travel as an Arrow table: the rows of a list would be read by Python
    workers of another kind, which stay beside the others on every executor.
    """
    fields = StructType.fromDDL(ddl)
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    kinds = to_arrow_schema(fields)
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds.types, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=kinds), fields)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only on a local master without that setting."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lamina-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting for the time of the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Written:
    """A table written to the shared folder, which cuts lineage and survives lost executors.

    Nothing reads the shuffles of the write again, so their files go with its end.
    """

    def __init__(self, df: DataFrame, name: str = "t") -> None:
        spark = df.sparkSession
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        with setting(spark, FREE_SHUFFLES, "true"):
            df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        _SCOPES[-1].append(self)

    def drop(self) -> None:
        """Delete the files; only when nothing will read the table again."""
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        for scope in _SCOPES:
            if self in scope:
                scope.remove(self)


#: The tables written in each open scope; what no scope holds stays until ``drop_all``.
_SCOPES: list[list[Written]] = [[]]


@contextmanager
def scratch() -> Iterator[Callable[[Written], Written]]:
    """A scope at whose end the tables written in it are dropped, but not those given to the function it yields."""
    kept: list[Written] = []
    _SCOPES.append([])
    try:
        yield lambda x: kept.append(x) or x
    finally:
        left = _SCOPES.pop()
        _SCOPES[-1].extend(x for x in left if x in kept)
        for x in left:
            if x not in kept:
                x.drop()


def drop_all() -> None:
    """Delete every table that operators have left; only when their results have been read or written."""
    for x in list(_SCOPES[0]):
        x.drop()


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that no column has, whatever its case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], share: int = 200) -> DataFrame:
    """``rows`` joined by ``keys`` with ``facts``, which has one row for each key and the number ``n`` of its rows.

    A key that holds more than one row in ``share`` is hot; fewer than ``share``
    keys can be, so their facts are broadcast, and the others meet by a shuffle.
    ``rows`` and ``facts`` are read twice and should be written tables.
    """
    total = facts.agg(F.sum("n")).first()[0] or 0
    hot = facts.where(F.col("n") * share > total)
    if not hot.limit(1).count():
        return rows.join(facts, keys)
    cold = facts.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def meet(rows: DataFrame, keys: DataFrame, on, how: str = "inner", most: int = 1_000_000) -> DataFrame:
    """``rows`` joined with ``keys``, a written table of a few longs a row.

    Up to ``most`` rows, about 100 MB in memory, ``keys`` are counted and
    broadcast, so that texts in ``rows`` are not shuffled; beyond it both are.
    """
    return rows.join(F.broadcast(keys) if keys.count() <= most else keys, on, how)


def slice_of(n: int, k: int, part: int = 0, most: float = 1.0) -> tuple[int, int]:
    """The hashes (after, up to) of 63 bits that about ``k`` of ``n`` rows have, ``most`` of them at most; parts do not overlap.

    A slice is never empty, whatever ``n``: with more rows than hashes it holds one hash.
    """
    top = (1 << 63) - 1
    width = max(1, min(int(most * 2**32) * top >> 32, k * top // max(1, n)))
    return min(top, part * width) - (part == 0), min(top, (part + 1) * width)


def sampled(rows: DataFrame, by: str, counts: dict, k: int, identity: list[str], part: int = 0, most: float = 1.0) -> DataFrame:
    """About ``k`` rows, and at most twice as many, of each value of ``by``, by the order of a hash of ``identity``.

    ``counts`` has the number of rows of each value; another ``part`` has other
    rows.  Rows that repeat ``identity`` have one hash, so the sample is cut at
    last, in that order.
    """
    at, ends, nth = (fresh(x, rows.columns) for x in ("sample_at", "sample_ends", "sample_nth"))
    bounds = F.create_map(*[x for key, n in counts.items() for x in (F.lit(key), F.array(*map(F.lit, slice_of(n, k, part, most))))])
    hashed = rows.withColumn(at, F.shiftrightunsigned(F.xxhash64(*identity), 1)).withColumn(ends, bounds[F.col(by)])
    some = hashed.where((F.col(at) > F.col(ends)[0]) & (F.col(at) <= F.col(ends)[1]))
    order = Window.partitionBy(by).orderBy(at, *identity)
    return some.withColumn(nth, F.row_number().over(order)).where(F.col(nth) <= 2 * k).drop(at, ends, nth)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, label), label the smallest node.

    Alternating large-star and small-star steps; each step joins every edge with
    its end's smallest neighbour (an aggregate), so a node with very many
    neighbours is never gathered in one task.  Nodes without an edge do not
    appear.  Empty edges give an empty result.
    """
    now = Written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = mark(now.df)
    for _ in range(most_rounds if seen[0] else 0):
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = Written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = Written(both.where("b > a").join(least.df, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        low = Written(large.df.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.df.join(low.df, "a")
        step = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.df.select("a", F.col("m").alias("b")))
        nxt = Written(step.distinct(), "edges")
        for old in (now, least, large, low):
            old.drop()
        now, was, seen = nxt, seen, mark(nxt.df)
        if was == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    leaves = now.df.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    roots = now.df.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return leaves.unionByName(roots)
