"""Suffix-array dedup over sparse suffixes: passages of at least ``min_words`` words that occur more than once.

Of every window of ``min_words`` words the suffix at the minimiser, the word
position whose following ``anchor`` words have the smallest hash, is retained.
Equal windows retain the same position, so a repeated passage shares a retained
suffix in each of its windows.  Retained suffixes whose anchor occurs once are
dropped; of the rest all windows are hashed, and equal hashes meet after a sort
by (hash, place).  A window that occurs at several places is repeated; its
smallest (doc_id, position) is the first occurrence, and the words of every
other occurrence are ``removable``, but not where it overlaps its own first
occurrence.  So each word that goes is in an earlier occurrence, and the first
of all stays.  A window over the edge of an earlier passage may stand in two
parts: one after the cut, the other in the earlier text.

The windows of a passage have different hashes, so a passage that very many
documents share is spread over as many tasks as it has windows; a task passes
over the sorted rows and holds one of them.

Exact copies are told by the hash and length of the text: only the copy with the
smallest doc_id takes part, and the others are removable as a whole.

Words are what whitespace (bytes 32 and 9 to 13) separates; windows are equal
if their 64-bit hashes are.

Defined results: null texts and texts of fewer than ``min_words`` words have no
passages; rows that repeat both doc_id and text are one document and get the
same spans; null doc_ids come last in the order; an empty table gives an empty
result; other columns are ignored by ``repeated_passages`` and kept by
``cut_repeats``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, fresh, remote, scratch, table

MIN_WORDS = 50
ANCHOR = 30
_FACTOR = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
SUFFIXES = "key long, doc_id long, h long, pos int"
WINDOWS = "w long, doc_id long, h long, pos int"
#: own: where in the same text the window is first, or -1.
REPEATS = "doc_id long, h long, pos int, own int, first_doc long"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the factor and of its inverse, modulo 2 ** 64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << n.bit_length())
        for name, x in (("up", _FACTOR), ("down", pow(_FACTOR, -1, 1 << 64))):
            row = np.full(size, x, np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each range, alike for equal values wherever they stand."""
    up, down = _powers(len(values) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[1 : len(values) + 1], dtype=np.uint64)))
    return _mixed((total[ends] - total[starts]) * down[starts])


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a text."""
    edge = np.diff(np.concatenate(([True], _SPACE[raw], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    starts, ends = word_spans(raw)
    return _ranges(raw.astype(np.uint64) + np.uint64(1), starts, ends)


def anchors(hashes: np.ndarray, anchor: int) -> np.ndarray:
    """The hash of the ``anchor`` words from each position."""
    n = len(hashes) - anchor + 1
    return _ranges(hashes, np.arange(n), np.arange(anchor, len(hashes) + 1)) if n > 0 else np.empty(0, np.uint64)


def every_minimiser(keys: np.ndarray, window: int) -> np.ndarray:
    """For each ``window`` neighbouring keys the position of the smallest, the first of equals."""
    if len(keys) < window:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(keys, window)
    return np.concatenate([np.arange(a, min(a + 65536, len(views))) + views[a : a + 65536].argmin(axis=1) for a in range(0, len(views), 65536)])


def minimisers(keys: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest key, the first of equals, in every ``window`` neighbouring keys."""
    chosen = every_minimiser(keys, window)
    return chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))] if len(chosen) else chosen


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def suffix_batches(batches, min_words, anchor):
    """The retained suffixes of each text, and for each text a row without a key whose pos is its number of words."""
    for batch in batches:
        keys, sizes, at = [], [], []
        n_words = []
        for text in batch.column("text"):
            hashes = word_hashes(_bytes(text.as_py()))
            own = anchors(hashes, anchor)
            pos = minimisers(own, min_words - anchor + 1)
            keys.append(own[pos].view(np.int64))
            at.append(pos)
            sizes.append(len(pos))
            n_words.append(len(hashes))
        docs, h = batch.column("doc_id"), batch.column("h")
        row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        if len(row):
            arrays = [pa.array(np.concatenate(keys)), docs.take(row), h.take(row), pa.array(np.concatenate(at).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "doc_id", "h", "pos"])
        if n_words:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(docs), pa.int64()), docs, h, pa.array(n_words, pa.int32())], names=["key", "doc_id", "h", "pos"])


def window_batches(batches, min_words, anchor):
    """Every window of ``min_words`` words whose minimiser is one of the chosen suffixes: its hash and place."""
    for batch in batches:
        docs, h = batch.column("doc_id"), batch.column("h")
        for i, (text, places) in enumerate(zip(batch.column("text"), batch.column("at").to_pylist(), strict=True)):
            hashes = word_hashes(_bytes(text.as_py()))
            if len(hashes) < min_words:  # a text under the same doc_id may be shorter
                continue
            least = every_minimiser(anchors(hashes, anchor), min_words - anchor + 1)
            start = np.flatnonzero(np.isin(least, np.array(places)))
            if len(start):
                found = _ranges(hashes, start, start + min_words).view(np.int64)
                row = pa.array(np.full(len(start), i))
                yield pa.RecordBatch.from_arrays([pa.array(found), docs.take(row), h.take(row), pa.array(start.astype(np.int32))], names=["w", "doc_id", "h", "pos"])


def repeat_batches(batches):
    """Of windows sorted by (w, place) those whose w is at two places or more, each with the smallest place."""
    held = None  # of the run that is open its first row, as a list, and whether it has been told
    for batch in batches:
        doc, absent = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        cols = [batch.column("w").to_numpy(), doc, absent, batch.column("h").to_numpy(), batch.column("pos").to_numpy()]
        told = False
        if held:
            cols, told = [np.concatenate((np.array([x], c.dtype), c)) for x, c in zip(held[0], cols, strict=True)], held[1]
        n = len(cols[0])
        if not n:
            continue
        new = np.concatenate(([True], cols[0][1:] != cols[0][:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        moved = np.logical_or.reduce([c != c[first] for c in cols[1:]])  # a repeated row is the same place
        runs = np.flatnonzero(new)
        several = np.logical_or.reduceat(moved, runs)
        tell = np.repeat(several, np.diff(np.concatenate((runs, [n])))) & (moved | new)
        if told:
            tell[0] = False
        held = ([c[runs[-1]] for c in cols], bool(several[-1] or (told and runs[-1] == 0)))
        at = np.flatnonzero(tell)
        if len(at):
            to = first[at]
            _, doc, absent, h, pos = cols
            here = (doc[at] == doc[to]) & (absent[at] == absent[to]) & (h[at] == h[to])
            arrays = [pa.array(doc[at], mask=absent[at]), pa.array(h[at]), pa.array(pos[at]), pa.array(np.where(here, pos[to], -1).astype(np.int32)), pa.array(doc[to], mask=absent[to])]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in REPEATS.split(", ")])


def span_batches(batches, min_words):
    """The disjoint spans (start, end, removable) of each document from its repeated windows."""
    for batch in batches:
        out = []
        for at in batch.column("at"):
            found = at.values
            pos, own = (found.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("pos", "own"))
            n = int(pos.max()) + min_words + 1
            every = covered(pos, pos + min_words, n)
            later = own != pos
            # A window that overlaps its own first occurrence leaves that one whole.
            cut = covered(np.where(own >= 0, np.maximum(pos, own + min_words), pos)[later], pos[later] + min_words, n)
            state = every.astype(np.int8) + cut
            edges = np.flatnonzero(np.diff(state)) + 1
            bounds = [0, *edges.tolist(), n]
            out.append([{"start": x, "end": y, "removable": bool(state[x] == 2)} for x, y in zip(bounds, bounds[1:], strict=False) if state[x]])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("removable", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(out, kind), batch.column("first_docs")], names=["doc_id", "h", "spans", "first_docs"])


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n words are in some range."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge)[:n] > 0


def passages_by_document(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, h, spans, first_docs): a row for each document with a repeated passage; spans (start, end, removable); h is xxhash64 of the text."""
    spark = docs.sparkSession
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    kept = Written(rows.select("doc_id", "h", "text").mapInArrow(remote("lamina.llm.suffixes:suffix_batches", min_words, anchor), SUFFIXES), "suffixes")
    suffixes = kept.df
    # Copies of a text: the smallest doc_id stands for all.
    whole = suffixes.where("key is null").select("doc_id", "h", F.col("pos").alias("n_words")).where(F.col("n_words") >= min_words).distinct()
    copied = Written(whole.groupBy("h", "n_words").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "copies").df
    copies = Written(whole.join(copied, ["h", "n_words"]).select("doc_id", "h", "n_words", "rep"), "copied").df
    others = copies.where("not (doc_id <=> rep)")
    # An anchor at different places, or in different texts, may belong to a passage.
    place = F.xxhash64("h", "pos")
    anchored = suffixes.where("key is not null")
    shared = Written(anchored.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("key"), "anchors").df
    chosen = anchored.join(shared, "key", "left_semi").groupBy("doc_id", "h").agg(F.collect_set("pos").alias("at"))  # bounded by the text's length
    same = lambda doc, h: F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col("h") == F.col(h))
    chosen = chosen.join(others.select(F.col("doc_id").alias("other"), F.col("h").alias("other_h")), same("other", "other_h"), "left_anti")
    chosen = Written(chosen.select(F.col("doc_id").alias("own"), F.col("h").alias("own_h"), "at"), "chosen").df
    joined = rows.join(chosen, same("own", "own_h")).select("doc_id", "h", "text", "at")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["w", F.col("doc_id").asc_nulls_last(), "h", "pos"]
    windows = joined.mapInArrow(remote("lamina.llm.suffixes:window_batches", min_words, anchor), WINDOWS).repartition(parts, "w").sortWithinPartitions(*order)
    repeats = Written(windows.mapInArrow(remote("lamina.llm.suffixes:repeat_batches"), REPEATS), "repeats").df
    kept.drop()
    grouped = repeats.groupBy("doc_id", "h").agg(F.collect_list(F.struct("pos", "own")).alias("at"), F.collect_set("first_doc").alias("first_docs"))  # bounded by the text's length
    spans = "array<struct<start:int,end:int,removable:boolean>>"
    inside = grouped.mapInArrow(remote("lamina.llm.suffixes:span_batches", min_words), f"doc_id long, h long, spans {spans}, first_docs array<long>")
    removable = ~F.col("doc_id").eqNullSafe(F.col("rep"))
    entire = copies.select("doc_id", "h", F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end"), removable.alias("removable"))).cast(spans).alias("spans"), F.array("rep").alias("first_docs"))
    both = inside.unionByName(entire).groupBy("doc_id", "h").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("first_docs")).alias("first_docs"))
    return both.select("doc_id", "h", F.array_sort(F.array_distinct("spans")).alias("spans"), F.array_sort(F.array_distinct(F.filter("first_docs", lambda x: x.isNotNull()))).alias("first_docs"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, h, start, end, removable): word spans that occur elsewhere too."""
    return passages_by_document(docs, min_words, anchor).select("doc_id", "h", F.explode("spans").alias("s")).select("doc_id", "h", "s.*")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def merged_batches(batches):
    for batch in batches:
        rows = []
        for doc, spans, firsts in zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), batch.column("first_docs").to_pylist(), strict=True):
            every = merged([(s["start"], s["end"]) for s in spans])
            cut = merged([(s["start"], s["end"]) for s in spans if s["removable"]])
            as_rows = lambda x: [{"start": a, "end": b} for a, b in x]
            rows.append((doc, as_rows(every), as_rows(cut), sum(b - a for a, b in every), sum(b - a for a, b in cut), firsts))
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = [pa.int64(), spans_type, spans_type, pa.int64(), pa.int64(), pa.list_(pa.int64())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "spans", "removable", "n_repeated", "n_removable", "first_docs"])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of 50 words or more that occur elsewhere too, as word spans."""
    found = passages_by_document(table(spark, sf_dir, "documents"))
    array = "array<struct<start:int,end:int>>"
    return found.select("doc_id", "spans", "first_docs").mapInArrow(remote("lamina.llm.suffixes:merged_batches"), f"doc_id long, spans {array}, removable {array}, n_repeated long, n_removable long, first_docs array<long>")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without word spans; each goes with the whitespace after it."""
    raw = text.encode("utf-8", "surrogatepass")
    starts, ends = word_spans(np.frombuffer(raw, np.uint8))
    out, at = [], 0
    for a, b in merged(spans):
        out.append(raw[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def cut_batches(batches, names, own):
    for batch in batches:
        texts, keep = [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column(own).to_pylist(), strict=True):
            cut = [(s["start"], s["end"]) for s in spans or () if s["removable"]]
            left = without(text, cut) if cut else text
            texts.append(left)
            keep.append(not cut or bool(left.strip()))
        out = batch.select(names).set_column(names.index("text"), "text", pa.array(texts, pa.string()))
        if "n_chars" in names:
            n = pa.array([None if t is None else len(t) for t in texts], out.schema.field("n_chars").type)
            out = out.set_column(names.index("n_chars"), "n_chars", n)
        yield out.filter(pa.array(keep, pa.bool_()))


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """All rows with their removable passages cut out of ``text`` (and n_chars counted anew); rows of which nothing is left go."""
    names = docs.columns
    doc, h, spans = (fresh(x, names) for x in ("cut_doc", "cut_h", "cut_spans"))
    with scratch() as keep:
        found = passages_by_document(docs, min_words, anchor).where(F.exists("spans", lambda s: s["removable"]))
        found = keep(Written(found.select(F.col("doc_id").alias(doc), F.col("h").alias(h), F.col("spans").alias(spans)), "cuts")).df
    own = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(h))
    return docs.join(found, own, "left").select(*[f"`{c}`" for c in names], spans).mapInArrow(remote("lamina.llm.suffixes:cut_batches", names, spans), docs.schema)
