"""Token counts of sections: whole documents are encoded once and tokens are attributed by their spans.

A section is a line with its line feed (or any given cuts).  Token byte spans
come from the ids alone: a byte-level token's length is its piece's.  Spans are
joined with sections by binary search over the section ends.  A token that
crosses sections is allocated by an explicit rule:

``first``     to the section of its first byte (the rule of the query);
``last``      to the section of its last byte;
``most``      to the section that holds most of its bytes, the earlier on a tie.

Under each rule every token is counted once, so a document's sections add up to
its tokens.  Offsets are reported in characters.

Defined results: a null or empty text has one empty section 0 without tokens;
a text that ends with a line feed has no empty section after it; repeated rows
and null doc_ids each give their own rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .common import remote, table

SCHEMA = "doc_id long, section int, start long, n_chars long, n_tokens long, n_crossing long"
RULES = ("first", "last", "most")


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, boundary-crossing tokens) of each section, from ascending byte ends of tokens and sections."""
    token_starts = np.concatenate(([0], token_ends[:-1])).astype(np.int64)
    first = np.searchsorted(section_ends, token_starts, side="right")
    last = np.searchsorted(section_ends, np.maximum(token_ends - 1, token_starts), side="right")
    crossing = np.flatnonzero(first != last)
    owner = (last if rule == "last" else first).copy()
    if rule == "most":
        for i in crossing:
            edges = [token_starts[i], *section_ends[first[i] : last[i]], token_ends[i]]
            owner[i] = first[i] + int(np.argmax(np.diff(edges)))
    n = len(section_ends)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def count_batches(batches, path, rule):
    enc = encoder(path)
    lengths = enc.byte_lengths()
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            raw = np.frombuffer(text.encode(), np.uint8)
            ends = np.flatnonzero(raw == 10) + 1
            if not len(ends) or ends[-1] < len(raw):
                ends = np.append(ends, len(raw))
            chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[ends]
            counts, crossing = attribute(np.cumsum(lengths[enc.encode(text)]), ends, rule) if len(raw) else ([0], [0])
            starts = np.concatenate(([0], chars[:-1]))
            for col, got in zip(cols, ([doc] * len(ends), range(len(ends)), starts, chars - starts, counts, crossing), strict=True):
                col.extend(got)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), *[pa.int64()] * 4), strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def section_token_counts(docs: DataFrame, path: str | None = None, rule: str = "first") -> DataFrame:
    """(doc_id, section, start, n_chars, n_tokens, n_crossing) for every line of every text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(remote("lamina.llm.tokencount:count_batches", path or default_path(), rule), SCHEMA)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of all documents, a crossing token going to the line of its first byte."""
    return section_token_counts(table(spark, sf_dir, "documents"))
