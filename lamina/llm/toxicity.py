"""Toxicity by a convolutional text classifier trained in numpy.

Words are hashed to embeddings; filters of one, two and three words run over
the whole text, their largest responses feed a logistic output.  Training is
plain Adagrad with gradients through the positions of the maxima.  Weights
begin at random, but the first embedding dimension at half the clipped log odds
of the labels among the texts with the word, and that dimension's filter and
output weights positive: with a few hundred toxic texts random embeddings find
a fifth fewer of them.  Embedding rows exist for hashes seen in training; any
other word is the zero vector.

Thresholds are calibrated by language on a part of the training rows that the
weights have not seen.  A text's language is the nearest of ``TONGUES``
centroids of the sampled texts' n-gram vectors, found without any column and
without labels; one with few calibration rows takes the threshold of all.  A
score is the output mapped so that 0.5 is the threshold.

The model is fitted on a bounded sample of labelled rows: about ``per_class``
documents of either label, twice as many at most, by the order of a hash of
doc_id.  Training and scoring cover whole texts of any length.

Defined results: null and wordless texts have the score of no response at all;
a doc_id with labels of both kinds counts as toxic, and one with several texts
is learnt from the one that sorts first; without labels of both kinds every
score is 0; repeated rows and null doc_ids each give their own row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid
from .common import remote, sampled, table
from .langid import fold

BUCKETS = 1 << 20
WIDTHS = (1, 2, 3)
FILTERS = 8
SIZE = 8
PER_CLASS = 3000
TONGUES = 8
#: A language has its own threshold from so many calibration rows of either label on.
FEWEST = 25
#: Hashed dimensions of the vectors that tell languages.
GRAMS = 1024
MOST_CACHED = 150_000
AT_ONCE = 500_000
_WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, score double"


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(text: str | None) -> np.ndarray:
    """Counts of the text's n-grams in few dimensions."""
    return langid.ngram_counts(text or "").reshape(-1, GRAMS).sum(axis=0)


@dataclass
class TextCnn:
    known: np.ndarray  # sorted hash buckets, whose embedding rows follow row 0, the zero vector; as an array, as every worker holds one
    embedding: np.ndarray
    filters: list[np.ndarray]  # by width: (width, SIZE, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[int, float]  # by the number of the language; -1: of all
    tongues: langid.Centroids | None = None

    def tongue(self, counts: np.ndarray) -> np.ndarray:
        """The language's number for each text, from its n-gram counts by row."""
        return (self.tongues.vector(counts) @ self.tongues.vectors.T).argmax(axis=1) if self.tongues else np.full(len(counts), -1)

    def pooled(self, ids: np.ndarray, cuts: np.ndarray, where: bool = False):
        """The largest response of every filter in each of the texts that ``cuts`` part; with the places of the maxima on request."""
        n = len(cuts) - 1
        big, places = [], []
        vectors = self.embedding[ids]
        for width, weights, bias in zip(WIDTHS, self.filters, self.bias, strict=True):
            # Each text is followed by zero rows, so short and empty texts have windows too.
            response = np.zeros((len(ids) - width + 1, FILTERS)) + bias
            for j in range(width):
                response += vectors[j : len(ids) - width + 1 + j] @ weights[j]
            np.maximum(response, 0, out=response)
            response[(cuts[1:-1, None] - np.arange(1, width)).ravel()] = 0  # windows into the next text
            best = np.maximum.reduceat(response, cuts[:-1], axis=0)
            big.append(best)
            if where:
                places.append(np.stack([cuts[i] + response[cuts[i] : cuts[i + 1] - width + 1].argmax(axis=0) for i in range(n)]))
        return (np.concatenate(big, axis=1), places) if where else np.concatenate(big, axis=1)

    def outputs(self, ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.pooled(ids, cuts) @ self.out + self.out_bias, -30, 30)))

    def score(self, output: float, language: int) -> float:
        at = self.thresholds.get(language, self.thresholds[-1])
        return 0.5 * output / at if output < at else 0.5 + 0.5 * (output - at) / (1 - at)


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of several texts in one array, each followed by zeros, and where they begin."""
    pad = np.zeros(max(WIDTHS), np.int64)
    cuts = np.cumsum([0] + [len(t) + len(pad) for t in texts])
    return np.concatenate([x for t in texts for x in (t, pad)]).astype(np.int64), cuts


def gradients(net: TextCnn, flat: np.ndarray, cuts: np.ndarray, labels: np.ndarray, weight: np.ndarray):
    """Of the weighted mean log loss: the embedding rows touched and their gradients, then those of filters, biases, output and its bias."""
    pooled, places = net.pooled(flat, cuts, where=True)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias, -30, 30)))
    error = (p - labels) * weight[labels] / len(labels)
    back = (error[:, None] * net.out) * (pooled > 0)
    grads_f, grads_b, touched, moved = [], [], [], []
    for k, (width, weights) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        own = back[:, k * FILTERS : (k + 1) * FILTERS]
        grad = np.zeros_like(weights)
        for j in range(width):
            at = flat[places[k] + j]
            grad[j] = np.einsum("nf,nfd->df", own, net.embedding[at])
            touched.append(at.ravel())
            moved.append((own[:, :, None] * weights[j].T[None]).reshape(-1, SIZE))
        grads_f.append(grad)
        grads_b.append(own.sum(axis=0))
    rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
    grad_e = np.zeros((len(rows), SIZE))
    np.add.at(grad_e, inverse, np.concatenate(moved))
    grad_e[rows == 0] = 0  # the zero vector stays
    return rows, grad_e, grads_f, grads_b, pooled.T @ error, float(error.sum())


def train(hashed: list[np.ndarray], counts: np.ndarray, labels: np.ndarray, stand_for: tuple[float, float] = (1.0, 1.0), epochs: int = 6, batch: int = 32, rate: float = 0.1, seed: int = 7, by_odds: bool = True) -> TextCnn:
    """A classifier from the hash buckets of texts' words, the texts' n-gram counts by row, and labels; ``stand_for``: how many rows a sampled row of each label stands for; ``by_odds``: whether the first dimension begins at log odds."""
    rng = np.random.default_rng(seed)
    known = np.unique(np.concatenate(hashed))
    ids = [(np.searchsorted(known, t) + 1).astype(np.int32) for t in hashed]
    held = np.arange(len(ids)) % 5 == 4  # for the thresholds
    fitted = np.flatnonzero(~held)
    embedding = rng.normal(0, 0.1, (len(known) + 1, SIZE))
    embedding[0] = 0
    net = TextCnn(known, embedding, [rng.normal(0, 0.3, (w, SIZE, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 0.3, FILTERS * len(WIDTHS)), 0.0, {-1: 0.5}, langid.fit(counts.astype(np.float32), ["text"] * len(counts), TONGUES))
    if by_odds:
        seen = np.zeros((2, len(known) + 1))
        for i in fitted:
            seen[labels[i], np.unique(ids[i])] += 1
        odds = (seen + 0.5) / (np.bincount(labels[fitted], minlength=2)[:, None] + 1)
        net.embedding[1:, 0] = (np.clip(np.log(odds[1] / odds[0]), -3, 3) * (seen.sum(axis=0) >= 3) / 2)[1:]
        net.out = np.abs(net.out)
        for f in net.filters:
            f[0, 0] = np.abs(f[0, 0])
    squares = [np.full_like(x, 1e-6) for x in (net.embedding, *net.filters, *net.bias, net.out)] + [np.array(1e-6)]
    weight = len(fitted) / (2 * np.maximum(1, np.bincount(labels[fitted], minlength=2)))
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(fitted), max(1, len(fitted) // batch)):
            touched, grad_e, grads_f, grads_b, grad_out, grad_bias = gradients(net, *joined([ids[i] for i in some]), labels[some], weight)
            squares[0][touched] += grad_e**2
            net.embedding[touched] -= rate * grad_e / np.sqrt(squares[0][touched])
            for s, x, g in zip(squares[1:-1], [*net.filters, *net.bias, net.out], [*grads_f, *grads_b, grad_out], strict=True):
                s += g**2
                x -= rate * 0.3 * g / np.sqrt(s)
            squares[-1] += grad_bias**2
            net.out_bias -= rate * 0.3 * grad_bias / float(np.sqrt(squares[-1]))
    calibrate(net, net.tongue(counts[held]), [ids[i] for i in np.flatnonzero(held)], labels[held], stand_for)
    return net


def calibrate(net: TextCnn, told: np.ndarray, ids: list[np.ndarray], labels: np.ndarray, stand_for: tuple[float, float]) -> None:
    """Set the threshold of each language, as told from the texts, to the one with the largest F1, and that of all."""
    if not len(ids):
        return
    out = np.concatenate([net.outputs(*joined(ids[i : i + 64])) for i in range(0, len(ids), 64)])

    def best(chosen: np.ndarray) -> float:
        p, y = out[chosen], labels[chosen]
        tried = np.unique(np.round(p, 6))
        tried = np.concatenate(([0.5], (tried[1:] + tried[:-1]) / 2))
        w = np.array(stand_for)[y]
        f1 = [2 * w[(p >= t) & (y == 1)].sum() / max(1.0, w[p >= t].sum() + w[y == 1].sum()) for t in tried]
        top = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
        return float(np.clip(tried[top[np.argmin(abs(tried[top] - 0.5))]], 0.02, 0.98))  # of equals the one nearest the middle

    if 0 < labels.sum() < len(labels):
        net.thresholds[-1] = best(np.ones(len(out), bool))
    for number in np.unique(told):
        own = told == number
        if min(labels[own].sum(), (1 - labels[own]).sum()) >= FEWEST:
            net.thresholds[int(number)] = best(own)


class _Rows(dict):
    def __init__(self, known: np.ndarray) -> None:
        self.known = known.astype(np.int64)  # a search for a long would copy an array of another kind each time

    def __missing__(self, word: str) -> int:
        own = bucket(word)
        at = int(self.known.searchsorted(own))
        row = self[word] = at + 1 if at < len(self.known) and self.known[at] == own else 0
        return row


def scored(texts: list[str | None], net: TextCnn, cache: _Rows) -> np.ndarray:
    found = [words(t) for t in texts]
    if len(cache) > MOST_CACHED:
        cache.clear()
    out = net.outputs(*joined([np.fromiter(map(cache.__getitem__, f), np.int64, len(f)) for f in found]))
    told = net.tongue(np.stack([grams(t) for t in texts]).astype(np.float32)) if len(net.thresholds) > 1 else [-1] * len(texts)
    return np.array([net.score(o, int(k)) for o, k in zip(out, told, strict=True)])


def learn_batches(batches):
    for batch in batches:
        for part in portions(batch):
            texts = part.column("text").to_pylist()
            ids = [np.fromiter(map(bucket, f), "<i4", len(f)).tobytes() for f in map(words, texts)]
            counts = [grams(t).astype("<f4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "toxic", "ids", "grams"])


def portions(batch: pa.RecordBatch):
    """Slices of a batch of about ``AT_ONCE`` characters, a row at least."""
    sizes = [len(t.as_py() or "") for t in batch.column("text")]
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > AT_ONCE and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def score_batches(batches, net):
    cache = _Rows(net.known) if net else None
    for batch in batches:
        for part in portions(batch):
            got = scored(part.column("text").to_pylist(), net, cache) if net else np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got, pa.float64())], names=["doc_id", "score"])


def keep_batches(batches, net):
    cache = _Rows(net.known)
    for batch in batches:
        for part in portions(batch):
            yield part.filter(pa.array(scored(part.column("text").to_pylist(), net, cache) < 0.5))


def fit_on(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> TextCnn | None:
    """A classifier from rows of ``labels`` (doc_id, toxic) where ``learn`` holds."""
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic").cast("int") != 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(counts) < 2:
        return None
    chosen = sampled(known, "toxic", counts, per_class, ["doc_id"])  # at most four times per_class rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    # Only hashes of words, four bytes each, and n-gram counts come to the driver.
    got = one.mapInArrow(remote("lamina.llm.toxicity:learn_batches"), "doc_id long, toxic int, ids binary, grams binary").toArrow()
    ids, toxic = got.column("doc_id").to_pylist(), got.column("toxic").to_numpy()
    if len(set(toxic)) < 2:
        return None
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i]))  # the order of arrival may change
    stand_for = tuple(max(1.0, counts[i] / per_class) for i in (0, 1))
    return train([np.frombuffer(got.column("ids")[i].as_py(), "<i4") for i in order], np.stack([np.frombuffer(got.column("grams")[i].as_py(), "<f4") for i in order]), toxic[order], stand_for)


def score(docs: DataFrame, net: TextCnn | None) -> DataFrame:
    """(doc_id, score) for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(remote("lamina.llm.toxicity:score_batches", net), SCHEMA)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, fit_on(docs, labels, fold(5) != 0))
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not toxic, all columns as they were."""
    net = fit_on(docs, labels, fold(5) != 0)
    return docs if net is None else docs.mapInArrow(remote("lamina.llm.toxicity:keep_batches", net), docs.schema)
