"""Byte-level BPE ids of whole texts, those that ``tokenizers`` gives for a tokenizer file.

The file's vocabulary is loaded into ``tiktoken``, whose merge loop returns the
same ids several times faster and straight into a numpy buffer.  A text with a
special token's name, or with characters that the two engines' patterns may
class differently, goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Word pattern of this tokenizer family (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the engines' whitespace and letter tables may not agree on.
_UNCLEAR = re.compile("[\x1c-\x1f\x85᠎​﻿\U00010000-\U0010ffff]")
_OPEN: dict[str, BpeEncoder] = {}


def byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeEncoder:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        stand_in = byte_of_char()
        self.bytes_of = {i: bytes(stand_in[c] for c in piece) for piece, i in vocab.items() if piece not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks={b: i for i, b in self.bytes_of.items()}, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as uint32."""
        if not text:
            return np.empty(0, np.uint32)
        if _UNCLEAR.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def byte_lengths(self) -> np.ndarray:
        """The number of text bytes that each id stands for."""
        out = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for i, piece in self.bytes_of.items():
            out[i] = len(piece)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            out[i] = len(token.content.encode())
        return out


def encoder(path: str) -> BpeEncoder:
    """The encoder of a file, opened once in each Python worker."""
    if path not in _OPEN:
        _OPEN[path] = BpeEncoder(path)
    return _OPEN[path]


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
