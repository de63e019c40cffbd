"""SimHash near-duplicates through covering locality-sensitive hashing.

Every bit position i has a nonzero code m(i) of radius+1 bits.  For each nonzero
v of radius+1 bits a table keeps the positions where m(i) and v share an odd
number of bits.  The codes of any ``radius`` positions leave some v orthogonal
to them all, so fingerprints that differ there agree on that v's whole mask:
every pair within the radius meets in some table.

Inside a bucket nothing is paired.  Two fingerprints lie within two bits exactly
if the balls of radius one around them share a point, so each member of a
bucket emits its ball over the bits the mask leaves free; at most
free + 1 distinct fingerprints can meet in one point, whatever the bucket's
size, and every meeting is a true link.

``near_copies`` and ``keep_one`` check such links by exact similarity, and find
the alike texts whose fingerprints lie farther apart by prefix filtering over
the shingles: see there.

Defined results: null and wordless texts have fingerprint zero and are linked
like any other; fewer words than a shingle make one shingle of all; null
doc_ids are kept and name a component only if all its ids are null;
repeated rows all come back; an empty table gives an empty result; other
columns are ignored by ``simhash_components``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, attach, components, fresh, meet, remote, scratch, table

#: One text of so many is read to find common shingles, of which at most so many are told apart.
SAMPLE, COMMON = 16, 100_000
#: Nodes that may meet at a shingle before those near their largest group are compared by what sets them apart from it.
CROWD = 32

_ONES = np.uint64(0x0101010101010101)


def over_half(hashes: np.ndarray) -> int:
    """The 64-bit word whose bit is set where over half of ``hashes`` have it set."""
    n = len(hashes)
    cuts = np.arange(0, n, 255)
    out = np.uint64(0)
    for shift in range(8):
        # Eight byte-wide counters in a word; 255 additions cannot overflow one.
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _ONES, cuts)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n):
            out |= np.uint64(1) << np.uint64(8 * int(byte) + shift)
    return int(out)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of the text's shingles in order, repeats included; wordless texts have none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n)


def simhash(text: str | None, shingle: int) -> int:
    found = shingle_hashes(text, shingle)
    return over_half(found) if len(found) else 0


def fingerprint_batches(batches, shingle):
    for batch in batches:
        found = np.array([simhash(x.as_py(), shingle) for x in batch.column("text")], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(codes) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between the nodes of fingerprints of at most two differing bits; they connect what such pairs connect.

    ``prints`` has (s, fp, node): the fingerprint's kind, distinct fingerprints of that kind, and what each stands for.
    """
    masks = covering_masks(2)
    # Fingerprints take little room in files, so few tasks would read them; their keys are many.
    prints = prints.repartition(max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    keys = prints.select("s", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks)])).alias("x"), "fp", "node").select("s", "x.t", "x.k", "fp", "node")
    shared = Written(keys.groupBy("s", "t", "k").agg(F.count("*").alias("n")).where("n > 1").select("s", "t", "k"), "buckets").df
    ball = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(64) if not m >> i & 1]) for m in masks])
    met = keys.join(shared, ["s", "t", "k"]).select("s", "t", "fp", "node", F.explode(F.element_at(ball, F.col("t") + 1)).alias("flip"))
    points = met.groupBy("s", "t", F.col("fp").bitwiseXOR(F.col("flip")).alias("at")).agg(F.collect_list("node").alias("near")).where("size(near) > 1")
    return points.select(F.array_min("near").alias("b"), F.explode("near").alias("a")).where("a <> b").distinct()


def print_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between the nodes of ``prints`` (fp, node); they connect the nodes whose fingerprints are equal or linked."""
    firsts = Written(prints.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "print-firsts").df
    equal = attach(prints, firsts, ["fp"]).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = links(firsts.select(F.lit(0).alias("s"), "fp", F.col("first").alias("node")))
    return Written(equal.unionByName(near), "print-links").df


def simhash_components(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp long, component_id): component_id is the smallest doc_id reachable over links of at most two bits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch() as keep:
        marked = keep(Written(rows.mapInArrow(remote("lamina.llm.simhash:fingerprint_batches", shingle), "doc_id long, fp long"), "prints")).df
        groups = Written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "groups").df
        labels = Written(components(links(groups.select(F.lit(0).alias("s"), "fp", F.col("fp").alias("node")))), "labels").df
        named = groups.join(labels, groups.fp == labels.node, "left").select("fp", "n", "rep", F.coalesce("label", "fp").alias("label"))
        least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
        by_print = keep(Written(named.join(least, "label").select("fp", "n", "component_id"), "by-print")).df
    return attach(marked, by_print, ["fp"]).select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over 3-word shingles of all documents, linked within 2 bits."""
    found = simhash_components(table(spark, sf_dir, "documents"), 3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near-copies by similarity: fingerprints link first and the shingle sets check them; what lies farther apart meets by prefix filtering.


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted hashes of the text's shingles; wordless texts have none."""
    return np.unique(shingle_hashes(text, shingle))


def prefix_length(n: int, similarity: float) -> int:
    """Sets of n and at least as alike share an element of their first so many ones, in whatever order all sets have."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def in_order(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """``found`` by the order of all sets: hashes as they are, then those of ``common`` (sorted by hash, with ranks), the most common last."""
    if not len(common):
        return found
    at = np.minimum(np.searchsorted(common["hash"], found), len(common) - 1)
    rank = np.where(common["hash"][at] == found, common["rank"][at], 0)
    return found[np.argsort(rank, kind="stable")]


def sampled_batches(batches, shingle):
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            found = [shingle_set(x.as_py(), shingle) for x in batch.column("text").slice(at, 500)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["k"])


def parities(found: np.ndarray) -> np.ndarray:
    """One bit for each ending of the hashes, whether the number of hashes with it is odd: 256 bits in longs, or as many as hashes, to a power of two.

    Where two sets' bits differ, some hash is in one of them alone: their
    symmetric difference is no smaller than the number of differing bits.
    """
    bits = max(256, 1 << max(0, len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(bits: np.ndarray, longs: int) -> np.ndarray:
    """The parities of a set by fewer, shorter endings."""
    while len(bits) > longs:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def possible_batches(batches, similarity):
    """The pairs whose parities allow the similarity."""
    for batch in batches:
        most = (1 - similarity) / (1 + similarity) * (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) + 1e-9
        one, two = (batch.column(f"bits_{x}") for x in "ab")
        near = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = (side[i].values.to_numpy() for side in (one, two))
            longs = min(len(x), len(y))
            near[i] = np.bitwise_count((folded(x, longs) ^ folded(y, longs)).view(np.uint64)).sum() <= most[i]
        yield batch.select(["a", "b"]).filter(pa.array(near))


def around_batches(batches, similarity):
    """(node, pivot, core): what may be alike to a core node of its pivot, and whether it is one.

    Differing parities keep the triangle inequality: what is alike to a core
    node differs from the pivot in no more bits than the core may, and those of
    an alike pair.  ``most`` leaves unlike sets, which differ in half of all bits, out.
    """
    c = (1 - similarity) / (1 + similarity)
    for batch in batches:
        sizes, middles = (batch.column(x).to_numpy().astype(float) for x in ("n", "n_pivot"))
        one, two = (batch.column(x) for x in ("bits", "bits_pivot"))
        core, near = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
        for i, (n, m) in enumerate(zip(sizes, middles, strict=True)):
            x, y = (side[i].values.to_numpy() for side in (one, two))
            most = 0.42 * 64 * len(y) - 2.1 * c * m
            if most < 0 or not 0.9 * similarity * m - 1e-9 <= n <= 1.1 * m / similarity + 1e-9:
                continue
            longs = min(len(x), len(y))
            differ = np.bitwise_count((folded(x, longs) ^ folded(y, longs)).view(np.uint64)).sum()
            core[i] = longs == len(y) and differ <= most and 0.9 * m <= n <= 1.1 * m
            near[i] = core[i] or differ <= most + c * (1.1 * m + n) + 1e-9
        found = batch.select(["node", "pivot"]).append_column("core", pa.array(core))
        yield found.filter(pa.array(near))


def prefix_batches(batches, shingle, similarity, common):
    """(doc_id, h, the fingerprint, two hashes and the size of the shingle set, its prefix, its parities whole and by 256 endings)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            found = [shingle_hashes(x.as_py(), shingle) for x in part.column("text")]
            prints = np.array([over_half(x) if len(x) else 0 for x in found], np.uint64).view(np.int64)
            sets = [np.unique(x) for x in found]
            marks = [[xxhash.xxh64_intdigest(x.tobytes(), seed) for x in sets] for seed in (1, 2)]
            heads = [in_order(x, common)[: prefix_length(len(x), similarity)].view(np.int64) if len(x) else x.view(np.int64) for x in sets]
            odd = [parities(x) for x in sets]
            arrays = [part.column("doc_id"), part.column("h"), pa.array(prints), *(pa.array(np.array(m, np.uint64).view(np.int64)) for m in marks), pa.array([len(x) for x in sets], pa.int32()), pa.array(heads, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())), pa.array([folded(x, 4) for x in odd], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h", "fp", "x", "y", "n", "prefix", "bits", "few"])


def set_batches(batches, shingle):
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = [shingle_set(x.as_py(), shingle).view(np.int64) for x in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "own"])


def common_shingles(rows: DataFrame, shingle: int) -> np.ndarray:
    """(hash, rank) of the shingles that many texts of a sample have; they only set the order, so a sample loses no pair."""
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(remote("lamina.llm.simhash:sampled_batches", shingle), "k long").groupBy("k").agg(F.count("*").alias("n")).where("n > 2")
    got = counts.orderBy(F.desc("n"), "k").limit(COMMON).toArrow()
    found = np.zeros(got.num_rows, [("hash", np.uint64), ("rank", np.int64)])
    found["hash"] = got.column("k").to_numpy().view(np.uint64)
    found["rank"] = got.num_rows - np.arange(got.num_rows)
    return np.sort(found, order="hash")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, h, fp, first_doc, first_h): for each document with words its fingerprint and the first document of its group.

    A document is a doc_id with a text, told by the text's hash h; the first is
    the one with the smallest doc_id, then h.  Rows without a doc_id are left
    out.  Documents of one set of shingles are one node; nodes are linked exactly
    if the Jaccard similarity of their sets is ``similarity`` or more.

    The links of the nodes' fingerprints (of their first documents) come first,
    checked by that similarity.  Two bits reach only texts that are nearly the
    same, so groups that they leave apart are compared in an exact way: two
    alike sets share a shingle of their prefixes, so all pairs that can be alike
    meet.  Each node is compared with the first node of the smallest and of the
    largest group it meets at each shingle; then all that meet and are not
    connected yet are compared, if the parities of their sets allow it and they
    share as many shingles of their prefixes as alike ones must.  Where more than
    ``CROWD`` meet, those near the largest group there are compared by their edits
    instead: see ``by_edits``.
    """
    text = F.col("text").cast("string")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    with scratch() as keep:
        prefixes = rows.mapInArrow(remote("lamina.llm.simhash:prefix_batches", shingle, similarity, common_shingles(rows, shingle)), "doc_id long, h long, fp long, x long, y long, n int, prefix array<long>, bits array<long>, few array<long>")
        # Both are written, so rows and nodes keep their numbers.
        marked = keep(Written(prefixes.where("n > 0").withColumnRenamed("n", "size").withColumn("row", F.monotonically_increasing_id()), "prefixes")).df
        first = F.min(F.struct("doc_id", "h", "row")).alias("first")
        named = marked.groupBy("x", "y", "size").agg(first, F.count("*").alias("n"))
        named = Written(named.select("*", F.monotonically_increasing_id().alias("node")), "nodes").df
        own = named.select("node", "first.*")
        sets = marked.select("row", "fp", "prefix", "bits", "few", F.col("size").alias("n")).join(own.select("row", "node"), "row")
        sets = Written(sets.select("node", "n", "fp", "prefix", "bits", *(F.col("few")[i].alias(f"bits{i}") for i in range(4))), "sets").df
        bits = sets.drop("prefix", "fp")
        printed = Written(alike(rows, own, bits, print_links(sets.select("fp", "node")), shingle, similarity), "printed").df
        groups = Written(components(printed), "groups").df
        keys = sets.select("node", "n", "prefix").join(groups, "node", "left").select(F.explode("prefix").alias("k"), "node", "n", F.coalesce("label", "node").alias("label"))
        shared = keys.groupBy("k").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
        met = Written(keys.join(shared, "k"), "met").df
        ends = F.explode(F.array("least", "most")).alias("end")
        stars = met.select("node", "label", ends).where("label <> end").select(F.greatest("node", "end").alias("a"), F.least("node", "end").alias("b")).distinct()
        close = Written(printed.unionByName(alike(rows, own, bits, stars, shingle, similarity)), "close").df
        labels = Written(components(close), "labels").df
        counted = labels.join(labels.groupBy("label").agg(F.count("*").alias("members")), "label")
        placed = met.select("k", "node", "n").join(counted, "node", "left").select("k", "node", "n", F.coalesce("label", "node").alias("label"), F.coalesce("members", F.lit(1)).alias("members"))
        placed = Written(placed, "placed").df
        open_ = placed.groupBy("k").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max_by("label", "members").alias("pivot"), F.count("*").alias("met"))
        open_ = open_.where("low <> high").select("k", F.when(F.col("met") > CROWD, F.col("pivot")).alias("pivot"))
        left = Written(placed.drop("members").join(open_, "k").join(bits.drop("n", "bits"), "node"), "open").df
        crowd = Written(left.where("pivot is not null").select("node", "label", "pivot").distinct(), "crowd").df
        core, edited, hub_links = by_edits(rows, own, bits, crowd, shingle, similarity)
        left = left.join(core, ["node", "pivot"], "left_anti")
        one, two = (left.select("k", *(F.col(c).alias(f"{c}_{i}") for c in ("node", "n", "label", *(f"bits{j}" for j in range(4))))) for i in "ab")
        fits = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9
        pairs = one.join(two, "k").where((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & fits & bits_near(similarity))
        # Beyond the prefix that ends first a set has n - prefix shingles, which is the floor of similarity * n or one less.
        most_beyond = similarity * F.greatest("n_a", "n_b") + 1
        enough = F.col("shared") >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - most_beyond
        pairs = pairs.groupBy("node_a", "node_b", "n_a", "n_b").agg(F.count("*").alias("shared")).where(enough)
        pairs = Written(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).unionByName(edited).distinct(), "pairs").df
        linked = Written(components(close.unionByName(hub_links).unionByName(alike(rows, own, bits, pairs, shingle, similarity))), "linked").df
        grouped = named.join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))
        firsts = grouped.groupBy("label").agg(F.min("first").alias("first"))
        by_set = keep(Written(grouped.drop("first").join(firsts, "label").select("x", "y", "size", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.h").alias("first_h")), "firsts")).df
    return attach(marked.select("doc_id", "h", "fp", "x", "y", "size"), by_set, ["x", "y", "size"]).select("doc_id", "h", "fp", "first_doc", "first_h")


def sets_of(rows: DataFrame, own: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, own): the shingle sets of the nodes ``wanted`` (node)."""
    wanted = Written(own.join(wanted, "node").select("node", F.col("doc_id").alias("own_doc"), F.col("h").alias("own_h")), "wanted").df
    texts = meet(rows, wanted, (F.col("doc_id") == F.col("own_doc")) & (F.col("h") == F.col("own_h"))).select("node", "text")
    return Written(texts.mapInArrow(remote("lamina.llm.simhash:set_batches", shingle), "node long, own array<long>"), "sets").df


def by_edits(rows: DataFrame, own: DataFrame, bits: DataFrame, crowd: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, pivot) of core nodes, pairs (a, b) that can be alike of a core node and another one, and links (a, b) of alike ones.

    ``crowd`` has (node, label, pivot), all that meet where a pivot was chosen.
    The middle of a pivot is the set of shingles that most of its core nodes have;
    the edits of a node are the shingles that it or the middle has alone, and two
    sets differ in the edits that one of them has alone.  ``over`` is their number
    less what half a pair may have: two nodes that share no edit are alike if the
    sum of theirs is not above zero, and then so is each with the node that has
    the least.  Others must share half of that sum, and meet by prefix
    filtering over the edits, the rarest first.  What all of a group have is no
    edit, so many of one text do not meet by it.
    """
    c = (1 - similarity) / (1 + similarity)
    sized = bits.select("node", "n", "bits")
    middles = sized.select(F.col("node").alias("pivot"), F.col("n").alias("n_pivot"), F.col("bits").alias("bits_pivot"))
    near = crowd.select("node", "pivot").join(sized, "node").join(middles, "pivot")
    near = Written(near.mapInArrow(remote("lamina.llm.simhash:around_batches", similarity), "node long, pivot long, core boolean"), "around").df
    wanted = near.select("node").unionByName(near.select(F.col("pivot").alias("node"))).distinct()
    sets = sets_of(rows, own, wanted, shingle)
    apart = lambda x, y: F.concat(F.array_except(x, y), F.array_except(y, x))
    both = near.join(sets, "node").join(sets.select(F.col("node").alias("pivot"), F.col("own").alias("other")), "pivot").join(crowd, ["node", "pivot"])
    first = Written(both.select("node", "pivot", "label", "core", F.size("own").alias("n"), apart("own", "other").alias("edits")), "first-edits").df
    cores = first.where("core").groupBy("pivot").agg(F.count("*").alias("cores"))
    most = first.where("core").select("pivot", F.explode("edits").alias("e")).groupBy("pivot", "e").agg(F.count("*").alias("n")).join(cores, "pivot").where("2 * n > cores")
    moved = first.join(most.groupBy("pivot").agg(F.collect_list("e").alias("most")), "pivot", "left")
    edits = moved.withColumn("edits", F.coalesce(apart("edits", "most"), "edits")).drop("most").withColumn("size", F.size("edits")).withColumn("over", F.col("size") - c * F.col("n"))
    edits = Written(edits, "edits").df
    hubs = edits.groupBy("pivot").agg(F.min_by("node", "over").alias("hub"), F.min("over").alias("low"))
    edits = Written(edits.join(hubs, "pivot"), "hubs").df
    links = edits.where("node <> hub and over + low <= 1e-9").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    every = edits.select("pivot", "node", F.explode("edits").alias("e"))
    common = Written(every.groupBy("pivot", "e").agg(F.count("*").alias("df")).where("df > 1"), "common").df
    shared = every.join(common, ["pivot", "e"]).groupBy("node", "pivot").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("shared"))
    # So many a partner shares at least: one that is not linked to the hub, or any if the node is not.
    linked = F.col("over") + F.col("low") <= 1e-9
    least = F.greatest(F.lit(1), F.ceil(F.when(linked, (F.col("over") - F.col("low")) / 2).otherwise(F.greatest((F.col("over") + F.col("low")) / 2, F.col("over") - c / similarity * F.col("n"))) - 1e-6))
    heads = edits.drop("edits").join(shared, ["node", "pivot"]).withColumn("linked", linked).withColumn("alone", F.col("size") - F.size("shared"))
    heads = heads.withColumn("shared", F.slice("shared", 1, F.greatest(F.lit(0), (F.col("size") - least + 1 - F.col("alone")).cast("int"))))
    heads = heads.select("node", "pivot", "label", "core", "linked", "n", "size", "over", "alone", F.posexplode("shared").alias("at", "x"))
    # ``rest`` edits of the node stand from this one on.
    heads = heads.select("pivot", F.col("x.e").alias("e"), "node", "label", "core", "linked", "n", "over", (F.col("size") - F.col("alone") - F.col("at")).alias("rest"))
    heads = Written(heads.join(bits.drop("n", "bits"), "node"), "heads").df
    few = [f"bits{j}" for j in range(4)]
    one, two = (heads.select("pivot", "e", *(F.col(x).alias(f"{x}_{i}") for x in ("node", "label", "core", "linked", "n", "over", "rest", *few))) for i in "ab")
    some = (F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & (F.col("core_a") | F.col("core_b")) & ~(F.col("linked_a") & F.col("linked_b"))
    enough = F.least("rest_a", "rest_b") >= (F.col("over_a") + F.col("over_b")) / 2 - 1e-6
    pairs = one.join(two, ["pivot", "e"]).where(some & enough & bits_near(similarity))
    pairs = Written(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "edited").df
    return near.where("core").select("node", "pivot"), pairs, Written(links, "hub-links").df


def bits_near(similarity: float):
    """Whether the parities ``bits0`` to ``bits3`` of a pair's sides, of ``n`` shingles, allow the similarity."""
    differ = sum((F.bit_count(F.col(f"bits{j}_a").bitwiseXOR(F.col(f"bits{j}_b"))) for j in range(1, 4)), F.bit_count(F.col("bits0_a").bitwiseXOR(F.col("bits0_b"))))
    return differ <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-9


def alike(rows: DataFrame, own: DataFrame, bits: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are ``similarity`` alike.

    ``own`` has (node, doc_id, h) of a document of each node and ``bits`` (node,
    n, bits) the size and the parities of its set, which spare most pairs the sets.
    """
    one, two = (bits.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    sized = pairs.join(one, "a").join(two, "b").where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9)
    pairs = Written(sized.mapInArrow(remote("lamina.llm.simhash:possible_batches", similarity), "a long, b long"), "possible").df
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = sets_of(rows, own, wanted, shingle)
    one, two = (sets.select(F.col("node").alias(x), F.col("own").alias(f"own_{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").withColumn("same", F.size(F.array_intersect("own_a", "own_b")))
    return both.where(F.col("same") >= similarity * (F.size("own_a") + F.size("own_b") - F.col("same")) - 1e-9).select("a", "b")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each group of near-duplicates the first document, all columns as they were.

    Of rows that repeat both doc_id and text of such a document one stays; rows
    of one doc_id with unlike texts are different documents.  Rows without a
    doc_id or without words are in no group and all stay.
    """
    found = near_copies(docs, shingle, similarity)
    stays = (F.col("doc_id") == F.col("first_doc")) & (F.col("h") == F.col("first_h"))
    doc, h, fate = (fresh(x, docs.columns) for x in ("near_doc", "near_h", "near_fate"))
    # Of interest: documents that go, and rows that repeat one that stays.
    fates = found.groupBy(F.col("doc_id").alias(doc), F.col("h").alias(h)).agg(F.max(F.when(stays, 2).otherwise(1)).alias(fate), F.count("*").alias("n"))
    fates = Written(fates.where(f"{fate} = 1 or n > 1").select(doc, h, fate), "fates").df
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(h))
    once = meet(docs, fates, same, "left_anti")
    repeated = meet(docs, fates.where(f"{fate} = 2"), same).dropDuplicates([doc, h]).select(*[f"`{c}`" for c in docs.columns])
    return once.unionByName(repeated)
