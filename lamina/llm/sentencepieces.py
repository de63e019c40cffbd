"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces and their log scores come from a model file; nothing is trained.
The best segmentation maximises the sum of scores; of equal sums the one whose
last piece starts earlier wins.  A character that no piece covers costs ten
less than the lowest score and is written as byte pieces (or as the unknown
piece if the model has none).  Whitespace is written with the marker U+2581.

When no piece holds the marker after another character, a text may be cut
before markers, and around any character that no longer piece holds, without
changing the best path.  Such chunks repeat, so each worker keeps a bounded
cache of their ids; the score of a chunk is computed in double precision.

Defined results: null texts have null ids and are decoded to null; empty texts
have no ids; the marker itself in a text is decoded to a blank, which makes
that text not ``lossless``; invalid byte sequences are decoded to U+FFFD;
repeated rows and null doc_ids each give their own row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_path
from .common import remote, table

MARK = "▁"
#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
MOST_CACHED = 250_000
SCHEMA = "doc_id long, ids array<int>, n_pieces long, n_byte_pieces long, decoded_crc32 long, lossless boolean"


def _fields(buf: bytes):
    """(field number, value) of a protobuf message; values are ints, floats or bytes."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = buf[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    at = 0
    while at < len(buf):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = buf[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<f", buf, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<d", buf, at)[0], at + 8
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """([(piece, score, type)], whether a blank is put before the text) of a model file."""
    pieces, prefix = [], True
    with open(path, "rb") as file:
        data = file.read()
    for field, value in _fields(data):
        if field == 1:
            got = dict(_fields(value))
            pieces.append((got.get(1, b"").decode(), float(got.get(2, 0.0)), int(got.get(3, NORMAL))))
        elif field == 3:
            spec = dict(_fields(value))
            prefix = bool(spec.get(3, 1))
            if spec.get(2) or spec.get(4, 1):
                raise ValueError("models with a character map or whitespace removal are not supported")
    return pieces, prefix


@dataclass
class DoubleArray:
    """A trie over bytes: from state s, byte b leads to t = base[s] + b + 1 if check[t] = s; value[t] is a key's number or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        tree: dict = {}
        for key, number in keys.items():
            node = tree
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = number
        base, check, value = [0] * 1024, [-1] * 1024, [-1] * 1024
        check[0], lone, tail = 0, 1, 1
        todo = [(0, tree)]
        while todo:
            state, node = todo.pop()
            value[state] = node.get(-1, -1)
            labels = sorted(b for b in node if b >= 0)
            if not labels:
                continue
            if max(lone, tail) + 600 > len(check):
                base, check, value = (x + [y] * len(x) for x, y in ((base, 0), (check, -1), (value, -1)))
            while check[lone] >= 0 or lone <= labels[0]:
                lone += 1
            # Lone children fill gaps from the front; sets of them are looked for near the end, where room is.
            at = lone if len(labels) == 1 else max(lone, tail - 256)
            while any(check[at + b - labels[0]] >= 0 for b in labels):
                at += 1
            base[state] = at - labels[0] - 1
            for b in labels:
                check[at + b - labels[0]] = state
            tail = max(tail, at + labels[-1] - labels[0] + 1)
            todo.extend((at + b - labels[0], node[b]) for b in labels)
        return cls(*(np.array(x, np.int32) for x in (base, check, value)))


class Unigram:
    """Encoder and decoder over (pieces, blank before the text, trie)."""

    def __init__(self, pieces: list[tuple[str, float, int]], prefix: bool, trie: DoubleArray | None = None) -> None:
        self.pieces, self.prefix = pieces, prefix
        kept = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER) and p}
        self.trie = trie or DoubleArray.build({p.encode(): i for p, i in kept.items()})
        # With base one further and room after the end, a step needs no bounds check.
        self._base, self._check, self._value = (self.trie.base + 1).tolist(), [*self.trie.check.tolist(), *[-1] * 257], self.trie.value.tolist()
        normal = [s for _, s, kind in pieces if kind == NORMAL]
        top, low = max(normal, default=0.0), min(normal, default=0.0)
        # A user-defined piece beats any way to spell it.
        self._score = [len(p.encode()) * top - 0.1 if kind == USER else s for p, s, kind in pieces]
        self._gain = [self._score[i] if i >= 0 else -math.inf for i in self._value]
        self._single = {p.encode() for p in kept if len(p) == 1}
        self._unknown_score = low - UNKNOWN_PENALTY
        self._unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.bytes_at = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self._byte_ids = set(self.bytes_at.values())
        spelled = {i: bytes([b]) for b, i in self.bytes_at.items()}
        self._bytes = [spelled.get(i, b"" if kind == CONTROL else p.encode()) for i, (p, _, kind) in enumerate(pieces)]
        longer = [p for p in kept if len(p) > 1]
        inner = any(a != MARK and b == MARK for p in longer for a, b in zip(p, p[1:], strict=False))
        alone = "" if any("\n" in p for p in longer) else "\n"
        self._chunks = None if inner else re.compile(f"{alone}|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self._cache = _Cache(self.viterbi)

    def viterbi(self, chunk: str) -> tuple[int, ...]:
        raw = chunk.encode("utf-8", "surrogatepass")
        n, base, check, gain = len(raw), self._base, self._check, self._gain
        best = [-math.inf] * (n + 1)
        best[0] = 0.0
        start, ends_in = [0] * (n + 1), [-1] * (n + 1)  # of the best last piece at each place: where it starts, its state
        at = 0
        while at < n:
            here, state = best[at], 0
            for end in range(at, n):
                to = base[state] + raw[end]
                if check[to] != state:
                    break
                state = to
                if (got := here + gain[to]) > best[end + 1]:
                    best[end + 1], start[end + 1], ends_in[end + 1] = got, at, to
            lead = raw[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            if raw[at : at + width] not in self._single:
                got = here + self._unknown_score
                if got > best[at + width]:
                    best[at + width], start[at + width], ends_in[at + width] = got, at, -1
            at += width
        out: list[int] = []
        while at:
            if ends_in[at] >= 0:
                out.append(self._value[ends_in[at]])
            elif self.bytes_at:
                out.extend(self.bytes_at[b] for b in reversed(raw[start[at] : at]))
            else:
                out.append(self._unknown)
            at = start[at]
        return tuple(reversed(out))

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
        if self._chunks is None:
            return np.array(self.viterbi(marked), np.int32)
        return np.fromiter(chain.from_iterable(map(self._cache.__getitem__, self._chunks.findall(marked))), np.int32)

    def decode(self, ids) -> str:
        text = b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def byte_pieces(self, ids: np.ndarray) -> int:
        return int(np.isin(ids, list(self._byte_ids)).sum()) if self._byte_ids else 0


class _Cache(dict):
    """The ids of recent chunks: when full, all entries become the older half, from which those in use return."""

    def __init__(self, make) -> None:
        self.make, self.older = make, {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = self.older.pop(chunk, None) or self.make(chunk)
        if len(self) >= MOST_CACHED:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


_OPEN: dict[str, Unigram] = {}


def opened(path: str, arrays=None) -> Unigram:
    if path not in _OPEN:
        _OPEN[path] = Unigram(*read_model(path), trie=DoubleArray(*arrays) if arrays else None)
    return _OPEN[path]


def code_batches(batches, path, arrays):
    model = opened(path, arrays)
    for batch in batches:
        docs, texts = batch.column("doc_id"), batch.column("text")
        for at in range(0, len(docs), 500):  # ids take more room than the texts
            lists, counts, n_bytes, crcs, same = [], [], [], [], []
            for text in texts.slice(at, 500).to_pylist():
                if text is None:
                    for col in (lists, counts, n_bytes, crcs, same):
                        col.append(None)
                    continue
                ids = model.encode(text)
                back = model.decode(ids.tolist())
                for col, x in zip((lists, counts, n_bytes, crcs, same), (ids, len(ids), model.byte_pieces(ids), zlib.crc32(back.encode()), back == text), strict=True):
                    col.append(x)
            cols = [docs.slice(at, 500), *(pa.array(c, t) for c, t in ((lists, pa.list_(pa.int32())), (counts, pa.int64()), (n_bytes, pa.int64()), (crcs, pa.int64()), (same, pa.bool_())))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "n_pieces", "n_byte_pieces", "decoded_crc32", "lossless"])


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, n_pieces, n_byte_pieces, decoded_crc32, lossless) of every text."""
    path = path or default_path("piece_bpe_32k.model")
    trie = opened(path).trie  # the driver builds it once for all workers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(remote("lamina.llm.sentencepieces:code_batches", path, (trie.base, trie.check, trie.value)), SCHEMA)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and what they decode to."""
    return encode_and_decode(table(spark, sf_dir, "documents"))
