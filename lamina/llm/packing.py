"""Best-fit packing by minimum bin slack.

Each bin starts with the longest piece left, and a subset-sum dynamic program
over the available lengths, kept as a bitset of reachable sums, finds the
fullest combination beside it, which is then removed.  Pieces of one length are
alike, so the program sees a histogram of at most ``capacity`` counts and a
combination is removed as often as the counts allow at once: the work and the
driver's memory do not grow with the corpus.

Pieces get their place without meeting: each carries its rank among its length
in its task, small totals by (task, length) turn that into a rank in the
corpus, and the plan maps ranks to sequences and offsets.

Defined results: a null text is packed like an empty one (its end mark alone);
null doc_ids and repeated rows are packed like any others; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .common import Written, remote, table

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, task int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, sequence_id long, offset long"


def fullest(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """The fullest combination [(length, copies)] within ``capacity`` of counts[length] pieces; longer lengths first on a tie."""
    goal, full = 1, (1 << (capacity + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # (length, copies, sums reachable before)
    for length in np.flatnonzero(counts[1 : capacity + 1])[::-1] + 1:
        length, left, take = int(length), min(int(counts[length]), capacity // int(length)), 1
        while left:
            take = min(take, left)
            steps.append((length, take, goal))
            goal = (goal | goal << (length * take)) & full
            left -= take
            take *= 2
        if goal >> capacity & 1:
            break
    at = goal.bit_length() - 1
    found: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + take
            at -= length * take
    return sorted(found.items(), reverse=True)


def minimum_bin_slack(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, copies in each bin)])] that use up counts[length] pieces of each length."""
    left = np.array(counts, np.int64)
    plan = []
    while len(there := np.flatnonzero(left)):
        longest = int(there[-1])
        left[longest] -= 1
        inside = dict(fullest(left, capacity - longest))
        left[longest] += 1
        inside[longest] = inside.get(longest, 0) + 1
        bins = min(int(left[n]) // k for n, k in inside.items())
        for n, k in inside.items():
            left[n] -= bins * k
        plan.append((bins, sorted(inside.items(), reverse=True)))
    return plan


def placement(plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks, copies in a bin, first bin, offset of the first copy; one entry for each pattern with it."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for bins, inside in plan:
        offset = 0
        for length, copies in inside:
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, copies, first_bin, offset))
            used[length] = rank + bins * copies
            offset += length * copies
        first_bin += bins
    return {n: tuple(np.array(x, np.int64).T) for n, x in rows.items()}


def piece_batches(batches, path, capacity, end_id):
    enc = encoder(path)
    task = TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    end = np.array([end_id], np.uint32)
    for batch in (some.slice(at, 1000) for some in batches for at in range(0, some.num_rows, 1000)):
        cols: list[list] = [[] for _ in range(8)]
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids = np.concatenate((enc.encode(text.as_py() or ""), end)).astype("<u4")
            cuts = [*range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            for piece, (a, b) in enumerate(zip([0, *cuts], cuts, strict=False)):
                for col, x in zip(cols, (doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].view(np.int32), task, int(seen[b - a])), strict=True):
                    col.append(x)
                seen[b - a] += 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])


def place_batches(batches, places, names):
    for batch in batches:
        lengths = batch.column("length").to_numpy(zero_copy_only=False)
        ranks = batch.column("rank").to_numpy(zero_copy_only=False)
        sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        order = np.argsort(lengths, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            n = int(lengths[own[0]])
            first, copies, first_bin, at = places[n]
            k = np.searchsorted(first, ranks[own], side="right") - 1
            nth, copy = np.divmod(ranks[own] - first[k], copies[k])
            sequence[own], offset[own] = first_bin[k] + nth, at[k] + copy * n
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset) for each piece of each text; ids are its tokens."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = Written(rows.mapInArrow(remote("lamina.llm.packing:piece_batches", path or default_path(), capacity, end_id), PIECES), "pieces").df
    totals = Written(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-totals").df
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in totals.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        counts[length] = n
    places = placement(minimum_bin_slack(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("task").alias("t"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(Written(starts, "piece-starts").df, (F.col("task") == F.col("t")) & (F.col("length") == F.col("l")))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    placed = ranked.select(*names, (F.col("before") + F.col("nth")).alias("rank"))
    return placed.mapInArrow(remote("lamina.llm.packing:place_batches", places, names), PLACED)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents")).drop("ids")
