"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, each half has its own k-means codebook,
and a row lies in the cell of its pair of nearest centroids.  A query visits
cells in the order of the summed distances of their centroids, popped from a
heap (the multi-sequence order), until the visited cells hold ``share`` of all
rows, and more than the answer needs.  The rows of those cells are reranked by their cosine in double
precision, after each vector is scaled by a power of two, which changes no
cosine and keeps squares in range.

Random vectors leave an index nothing to exploit: at 64 dimensions over half of
the rows have to be visited for nine in ten neighbours, hence the default; data
with clusters need a much smaller share.  There are about ``9 * sqrt(rows)``
cells, so that walking them costs less than reranking.

Equal vectors are one entry of the index with its smallest ids, as many as an
answer can show, so a hot vector costs one entry.  Rows stay where they are, in
blocks of neighbouring cells; a query travels to the blocks that hold a cell it
visits, with the bits of those cells.

Defined results: a vector that is null or zero, or holds a null or a non-finite
number, takes no part; vectors of different lengths have no cosine, so each
length has an index of its own; of equal cosines the smaller vec_id comes
first; rows that repeat a vec_id with the same vector count once; a vec_id with
several vectors is as near as the nearest of them, and asks with all of them;
null vec_ids take no part; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, remote, scratch, slice_of, table

SAMPLE = 20_000
SHARE = 0.6
ROW_BLOCK = 8192
MOST_CENTROIDS = 256
PLACED = "gid binary, size int, vec binary, ids array<long>, asks int, cell int"
#: A row (vec, ids) or, with probes, a query; what is not said is null.
MET = "rb int, gid binary, vec binary, ids array<long>, cell int, probes binary"


def vector_batches(batches):
    """(vec_id, size, vec) of the usable vectors; vec holds little-endian doubles, minus zero as zero."""
    for batch in batches:
        ids, sizes, vecs = [], [], []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            if i is None or not v or any(x is None for x in v):
                continue
            x = np.array(v, "<f8") + 0.0
            if np.isfinite(x).all() and x.any():
                ids.append(i)
                sizes.append(len(x))
                vecs.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(vecs, pa.binary())], names=["vec_id", "size", "vec"])


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest number to between a half and one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 15, seed: int = 11) -> np.ndarray:
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


@dataclass
class MultiIndex:
    first: np.ndarray  # codebook of the first half
    second: np.ndarray
    offset: int = 0  # the number of its first cell among all indexes
    counts: np.ndarray | None = None  # entries of each cell
    blocks: tuple[np.ndarray, np.ndarray] | None = None  # first and last row block of each cell

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    @property
    def cut(self) -> int:
        return self.first.shape[1]

    def cell(self, x: np.ndarray) -> np.ndarray:
        u = unit(x)
        return nearest(u[:, : self.cut], self.first) * len(self.second) + nearest(u[:, self.cut :], self.second)

    def visited(self, x: np.ndarray, wanted: int) -> np.ndarray:
        """Cells in multi-sequence order until they hold ``wanted`` entries."""
        u = unit(x)
        a = ((self.first - u[: self.cut]) ** 2).sum(axis=1)
        b = ((self.second - u[self.cut :]) ** 2).sum(axis=1)
        order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b, counts, width = a[order_a].tolist(), b[order_b].tolist(), self.counts, len(b)
        heap, seen, out, held = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = int(order_a[i]) * width + int(order_b[j])
            out.append(cell)
            held += int(counts[cell])
            for p, q in ((i + 1, j), (i, j + 1)):
                if p < len(a) and q < width and (p, q) not in seen:
                    seen.add((p, q))
                    heapq.heappush(heap, (a[p] + b[q], p, q))
        return np.array(out)


def centroids_for(rows: int) -> int:
    return max(2, min(MOST_CENTROIDS, math.ceil(3 * rows**0.25)))


def by_size(batch: pa.RecordBatch):
    """(size, its rows) of the vector lengths in a batch."""
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        yield size, batch.filter(pa.array(sizes == size))


def vectors_of(column) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<f8") for v in column.to_pylist()])


def cell_batches(batches, indexes):
    for batch in batches:
        for size, own in by_size(batch):
            index = indexes[size]
            cells = index.cell(vectors_of(own.column("vec"))) + index.offset
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cells.astype(np.int32))], names=[*own.schema.names, "cell"])


def placed_batches(batches, indexes, share, least):
    """Every row in its block, and every query in each block with a cell it visits, with the bits of that block's cells from ``cell`` on."""
    names = [x.split()[0] for x in MET.split(", ")]
    for batch in batches:
        for size, own in by_size(batch):
            index = indexes[size]
            low, high = index.blocks
            cells = own.column("cell").to_numpy() - index.offset
            gids = own.column("gid").to_pylist()
            spread = np.array([int.from_bytes(g[:7], "big") for g in gids], np.int64)
            block = low[cells] + spread % (high[cells] - low[cells] + 1)
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), own.column("gid"), own.column("vec"), own.column("ids"), own.column("cell"), pa.nulls(len(gids), pa.binary())], names=names)
            wanted = max(least, math.ceil(share * int(index.counts.sum())))
            vecs, out = own.column("vec").to_pylist(), []
            for i in np.flatnonzero(own.column("asks").to_numpy()):
                visited = np.zeros(index.cells, bool)
                visited[index.visited(np.frombuffer(vecs[i], "<f8"), wanted)] = True
                there = np.flatnonzero(visited & (index.counts > 0))
                met = np.zeros(int(high.max()) + 2, np.int64)  # +1 where a visited cell's blocks begin, -1 after they end
                np.add.at(met, low[there], 1)
                np.add.at(met, high[there] + 1, -1)
                for rb in np.flatnonzero(np.cumsum(met)).tolist():
                    a, b = np.searchsorted(high, rb), np.searchsorted(low, rb, side="right")
                    out.append((rb, gids[i], vecs[i], None, int(a) + index.offset, np.packbits(visited[a:b]).tobytes()))
                if len(out) >= 2000:
                    yield _met(out, names)
                    out = []
            if out:
                yield _met(out, names)


def _met(rows, names):
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = scaled(a), scaled(b)
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a)) / math.sqrt(math.fsum(b * b))


class _Block:
    """The rows of the row block that is open: no more than a block has."""

    def __init__(self) -> None:
        self.number, self.parts = None, []

    def add(self, number: int, batch: pa.RecordBatch) -> None:
        if number != self.number:
            self.number, self.parts = number, []
        self.parts.append(batch)
        self.ready = False

    def open(self) -> None:
        if not self.ready:
            rows = pa.Table.from_batches(self.parts)
            self.x = vectors_of(rows.column("vec"))
            self.ids, self.cells, self.unit = rows.column("ids").to_pylist(), rows.column("cell").to_numpy(), unit(self.x)
            self.ready = True


def rerank_batches(batches, keep):
    """Of rows and queries sorted by block, rows first: the nearest entries of each block for each query, until they name ``keep`` ids."""
    block = _Block()
    for batch in batches:
        numbers, asks = batch.column("rb").to_numpy(), batch.column("probes").is_valid().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if a == b:
                continue
            if not asks[a]:
                block.add(int(numbers[a]), batch.slice(a, b - a))
                continue
            block.open()
            for at in range(a, b, 256):
                yield from _nearest_in(block, batch.slice(at, min(256, b - at)), keep)


def _nearest_in(block: _Block, queries: pa.RecordBatch, keep: int):
    q, gids, firsts = vectors_of(queries.column("vec")), queries.column("gid").to_pylist(), queries.column("cell").to_pylist()
    lines = unit(q) @ block.unit.T
    found = []
    for i, (line, probes) in enumerate(zip(lines, queries.column("probes").to_pylist(), strict=True)):
        bits = np.unpackbits(np.frombuffer(probes, np.uint8))
        at = block.cells - firsts[i]
        line[bits[np.clip(at, 0, len(bits) - 1)] == 0] = -np.inf
        wanted = keep
        while True:
            # Rounding may swap what is nearly equal: all within a hair of the last place are measured exactly.
            last = np.partition(line, -wanted)[-wanted] if len(line) > wanted else -np.inf
            close = np.flatnonzero((line > -np.inf) & (line >= last - 1e-9))
            exact = sorted((-cosine(q[i], block.x[c]), block.ids[c][0], int(c)) for c in close)
            if len(line) <= wanted or len({k for _, _, c in exact[:wanted] for k in block.ids[c]}) >= keep:
                break
            wanted *= 2  # one id has several of these vectors
        found += [(gids[i], -s, block.ids[c]) for s, _, c in exact[:wanted]]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.binary(), pa.float64(), pa.list_(pa.int64())), strict=True)], names=["gid", "score", "ids"])


def entries_of(vectors: DataFrame, k: int) -> DataFrame:
    """(gid, size, vec, ids, asks): equal vectors with the k smallest of their ids."""
    vectors = vectors.withColumn("gid", F.unhex(F.md5("vec")))
    ones = Written(vectors.groupBy("gid", "size", "vec").agg(F.min("vec_id").alias("least"), F.max("vec_id").alias("most"), F.max("asks").alias("asks")), "ones").df
    # Few ids of each repeated vector pass the rank before the shuffle, so a hot one's never meet in one task.
    rank = F.dense_rank().over(Window.partitionBy("gid").orderBy("vec_id"))
    several = ones.where("least <> most").select("gid")
    some = vectors.select("gid", "vec_id").join(several, "gid", "left_semi").withColumn("nth", rank).where(F.col("nth") <= k)
    ids = some.groupBy("gid").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    return ones.join(ids, "gid", "left").select("gid", "size", "vec", F.coalesce("ids", F.array("least")).alias("ids"), "asks")


def indexes_for(entries: DataFrame, totals: dict[int, int], sample: int) -> dict[int, MultiIndex]:
    """An index for each vector length, its codebooks from a bounded sample."""
    each = max(256, sample // len(totals))
    part = F.lit(False)
    for size, n in totals.items():
        part = part | ((F.col("size") == size) & (F.shiftrightunsigned(F.xxhash64("gid"), 1) <= slice_of(n, each)[1]))
    taught = entries.where(part).select("size", "gid", "vec").orderBy("size", "gid").toArrow()
    sizes, vecs = taught.column("size").to_numpy(), taught.column("vec").to_pylist()
    found, offset = {}, 0
    for size, n in sorted(totals.items()):
        own = [np.frombuffer(vecs[i], "<f8") for i in np.flatnonzero(sizes == size)]
        # A sample that caught nothing leaves a single cell, and with one number there is nothing to halve.
        learn = unit(np.stack(own)) if own else np.zeros((1, size))
        half, k = size // 2, centroids_for(n)
        found[size] = MultiIndex(k_means(learn[:, :half], k if half else 1), k_means(learn[:, half:], k), offset)
        offset += found[size].cells
    return found


def search(embeddings: DataFrame, is_query: Column, k: int = 5, share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row where ``is_query`` (of vec_id) holds."""
    spark = embeddings.sparkSession
    raw = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    with scratch() as kept:
        vectors = raw.mapInArrow(remote("lamina.llm.ann:vector_batches"), "vec_id long, size int, vec binary")
        vectors = kept(Written(vectors.withColumn("asks", F.coalesce(is_query, F.lit(False)).cast("int")), "vectors")).df
        entries = Written(entries_of(vectors, k + 1), "entries").df
        totals = {r["size"]: r["n"] for r in entries.groupBy("size").agg(F.count("*").alias("n")).collect()}  # a row for each length
        if not totals:
            return spark.range(0).selectExpr("id as query_id", "cast(id as int) as rank", "id as vec_id", "cast(id as double) as score")
        indexes = indexes_for(entries, totals, sample)
        placed = Written(entries.mapInArrow(remote("lamina.llm.ann:cell_batches", indexes), PLACED), "cells").df
        counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        block_rows = max(64, min(ROW_BLOCK, -(-sum(totals.values()) // parts)))
        blocks = 0
        for index in indexes.values():
            index.counts = np.array([counts.get(index.offset + c, 0) for c in range(index.cells)], np.int64)
            upto = np.cumsum(index.counts)
            index.blocks = (upto - index.counts) // block_rows + blocks, np.maximum(upto - 1, 0) // block_rows + blocks
            index.blocks = index.blocks[0], np.maximum(*index.blocks)
            blocks = int(index.blocks[1].max()) + 1
        met = placed.mapInArrow(remote("lamina.llm.ann:placed_batches", indexes, share, k + 1), MET)
        dealt = met.repartitionById(max(1, min(blocks, 4 * parts)), F.col("rb")).sortWithinPartitions("rb", F.col("probes").isNotNull())
        near = dealt.mapInArrow(remote("lamina.llm.ann:rerank_batches", k + 1), "gid binary, score double, ids array<long>")
        # The nearest k + 1 ids hold the k nearest beside the query's own; of an id the nearest vector counts.
        best = near.select("gid", F.explode("ids").alias("id"), "score").groupBy("gid", "id").agg(F.min(-F.col("score")).alias("far"))
        best = best.groupBy("gid").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "id"))), 1, k + 1).alias("near"))
        answers = kept(Written(best, "answers")).df
    own = vectors.where("asks = 1").select(F.col("vec_id").alias("query_id"), F.unhex(F.md5("vec")).alias("gid")).distinct()
    others = own.join(answers, "gid").select("query_id", F.explode("near").alias("x")).where("x.id <> query_id")
    each = others.groupBy("query_id", F.col("x.id").alias("vec_id")).agg(F.min("x.far").alias("far"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("far", "vec_id")).cast("int")
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", (-F.col("far")).alias("score"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of embeddings to every row whose vec_id is divisible by 50."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
