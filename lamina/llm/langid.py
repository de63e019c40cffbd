"""Language identification by nearest centroid over TF-IDF character n-grams.

A text is lower-cased, everything but letters becomes one blank, and the byte
n-grams of one to three bytes are counted in hashed dimensions over the whole
text.  Counts are damped, weighted by inverse document frequency and
normalised.  Each language has several centroids from spherical k-means, and a
text takes the language of the centroid with the largest cosine.  A text
farther from all centroids than nearly all known texts of that language and
about that length, by a margin, is ``rejected``.

The model is fitted on a bounded sample: of each language about
``per_language`` rows, twice as many at most, by the order of a hash of doc_id
and text.  The limits for rejection come from as many rows outside it, from
their beginnings of several lengths, as short texts have smaller cosines.

Defined results: null texts and texts without a letter are ``und`` with score 0
and rejected; without any labelled row every text is ``und``; of equal cosines
the language that sorts first wins; repeated rows and null doc_ids each give
their own row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remote, sampled, table

DIMENSIONS = 4096
PER_LANGUAGE = 500
CLUSTERS = 4
#: A text is rejected under this share of the cosine that this quantile of known texts of its language and length has.
REJECT_MARGIN, REJECT_QUANTILE = 0.8, 0.01
#: Characters of the beginnings of known texts on which the limits are measured.
LENGTHS = (8, 16, 32, 64, 128, 256, 512, 1024, 4096, 16384)
SHARPNESS = 25.0
_LETTER = regex.compile(r"\p{L}")  # as in fit_on
_PLAIN = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
SCHEMA = "doc_id long, lang_pred string, score double, cosine double, rejected boolean"


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of the n-grams of the whole text."""
    raw = _PLAIN[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    code = raw[np.concatenate(([True], (raw[1:] != 32) | (raw[:-1] != 32)))].astype(np.uint32)
    pair = code[:-1] << np.uint32(8) | code[1:]
    three = pair[:-1] << np.uint32(8) | code[2:]
    out = np.zeros(DIMENSIONS, np.int64)
    for n, grams in enumerate((code, pair, three), 1):
        hashed = (grams + np.uint32(n << 24)) * np.uint32(2654435761)
        out += np.bincount(hashed >> np.uint32(20), minlength=DIMENSIONS)
    return out


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    vectors: np.ndarray  # centroids by row
    owner: np.ndarray  # the language number of each centroid
    least: np.ndarray  # by language and LENGTHS: smaller best cosines are rejected

    def limits(self, language: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The limit for each text of so many letters and blanks."""
        at = np.log(np.maximum(letters, 1))
        every = np.stack([np.interp(at, np.log(LENGTHS), row) for row in self.least])
        return every[language, np.arange(len(language))]

    def vector(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts, dtype=np.float32) * self.idf
        norm = np.sqrt((weighted * weighted).sum(axis=-1, keepdims=True))
        return weighted / np.maximum(norm, 1e-12)

    def cosines(self, vectors: np.ndarray) -> np.ndarray:
        """The largest cosine for each language."""
        to_all = vectors @ self.vectors.T
        return np.stack([to_all[..., self.owner == i].max(axis=-1) for i in range(len(self.languages))], axis=-1)


def fit(counts: np.ndarray, langs: list[str], clusters: int = CLUSTERS, rounds: int = 12) -> Centroids:
    names = sorted(set(langs))
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Centroids(names, idf, np.empty((0, DIMENSIONS), np.float32), np.empty(0, int), np.full((len(names), len(LENGTHS)), -1.0))
    vectors = model.vector(counts)
    label = np.array([names.index(x) for x in langs])
    found, owner = [], []
    for i in range(len(names)):
        own = vectors[label == i]
        middle = own.mean(axis=0, keepdims=True)
        seeds = [int(np.argmax(own @ middle[0]))]
        while len(seeds) < min(clusters, len(own)):  # the text farthest from the seeds so far
            seeds.append(int(np.argmin((own @ own[seeds].T).max(axis=1))))
        centres = own[seeds]
        for _ in range(rounds):
            nearest = (own @ centres.T).argmax(axis=1)
            sums = np.stack([own[nearest == c].sum(axis=0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        found.append(centres)
        owner += [i] * len(centres)
    model.vectors, model.owner = np.concatenate(found), np.array(owner)
    return model


def count_batches(batches):
    for batch in batches:
        found = [ngram_counts(t.as_py()).astype("<i4").tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(found, pa.binary())], names=["lang", "counts"])


def predict_batches(batches, model):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        known = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)] if model else []
        langs, scores, best, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        for at in range(0, len(known), 256):
            some = known[at : at + 256]
            counts = np.stack([ngram_counts(texts[i]) for i in some])
            cos = model.cosines(model.vector(counts))
            top = cos.argmax(axis=1)
            soft = np.exp(SHARPNESS * (cos - cos.max(axis=1, keepdims=True)))
            best[some] = cos.max(axis=1).astype(np.float64)
            scores[some] = 1 / soft.sum(axis=1)
            rejected[some] = best[some] < model.limits(top, counts.sum(axis=1) // 3)
            for i, k in zip(some, top, strict=True):
                langs[i] = model.languages[k]
        arrays = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores), pa.array(best), pa.array(rejected)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang_pred", "score", "cosine", "rejected"])


def measured_batches(batches, model):
    """The best cosine of the beginnings of each text, by their length."""
    for batch in batches:
        rows = []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            parts = [(k, text[:n]) for k, n in enumerate(LENGTHS) if len(text) >= n and _LETTER.search(text[:n])]
            if parts:
                cos = model.cosines(model.vector(np.stack([ngram_counts(x) for _, x in parts]))).max(axis=1)
                rows += [(lang, k, float(c)) for (k, _), c in zip(parts, cos, strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.float64()), strict=True)], names=["lang", "k", "cosine"])


def calibrate(model: Centroids, rows: DataFrame) -> None:
    """Set the limits from rows outside the fit; a length without any takes the limit of the next shorter one."""
    got = rows.select("lang", "text").mapInArrow(remote("lamina.llm.langid:measured_batches", model), "lang string, k int, cosine double").toArrow()
    langs, k, cosine = np.array(got.column("lang").to_pylist()), got.column("k").to_numpy(), got.column("cosine").to_numpy()
    for i, name in enumerate(model.languages):
        before = -1.0
        for n in range(len(LENGTHS)):
            own = cosine[(langs == name) & (k == n)]
            before = model.least[i, n] = float(np.quantile(own, REJECT_QUANTILE)) * REJECT_MARGIN if len(own) else before


def fit_on(docs: DataFrame, train: Column, per_language: int = PER_LANGUAGE) -> Centroids | None:
    """A model from the rows of (doc_id, text, lang) where ``train`` holds and lang is known."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return None
    some = lambda part: sampled(rows, "lang", counts, per_language, ["doc_id", "text"], part, 0.75)
    got = some(0).select("lang", "text").mapInArrow(remote("lamina.llm.langid:count_batches"), "lang string, counts binary").toArrow()
    langs = got.column("lang").to_pylist()
    if not langs:
        return None
    both = sorted(zip(langs, got.column("counts").to_pylist(), strict=True))  # the order of arrival may change
    del got
    model = fit(np.stack([np.frombuffer(x, "<i4").astype(np.float32) for _, x in both]), [lang for lang, _ in both])
    calibrate(model, some(1))
    return model


def identify(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """(doc_id, lang_pred, score, cosine, rejected) for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(remote("lamina.llm.langid:predict_batches", model), SCHEMA)


def fold(modulus: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learnt from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_on(docs, fold(4) != 2))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "cosine", "rejected")


def keep_known(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows whose language is known and near enough, all columns as they were."""
    model = fit_on(docs, fold(4) != 2, per_language)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.mapInArrow(remote("lamina.llm.langid:keep_batches", model), docs.schema)


def keep_batches(batches, model):
    for batch in batches:
        (found,) = predict_batches([batch.select(["doc_id", "text"])], model)
        yield batch.filter(pa.compute.invert(found.column("rejected")))
