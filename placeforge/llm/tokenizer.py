"""A byte-level BPE vocabulary file, sent to the executors, and exact cached encoding."""

from __future__ import annotations

import base64

import numpy as np
import tiktoken
from pyspark.sql import SparkSession

#: Where the vocabulary is, unless told otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pattern of pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Strings that a worker remembers the encoding of, and how long these are at most: 300 000 of them take under 100 MB.
CACHE, LONGEST = 300_000, 64


def ship(spark: SparkSession, path: str = VOCABULARY):
    """Broadcast the file (about 1 MB) that the driver reads; executors need no copy of it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoding(vocabulary: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder(dict):
    """Encodes texts as little-endian ids, remembering words with the space before them.

    A text may be cut before every space that a non-space follows: pre-tokens never reach across.
    The first word that starts with white space makes the whole text take the plain way.
    """

    def __init__(self, vocabulary: bytes):
        self.plain = encoding(vocabulary)
        self.type = np.dtype("<u2" if self.plain.n_vocab < 2**16 else "<u4")

    def __missing__(self, word: str) -> bytes | None:
        made = self.raw(" " + word) if word and not word[0].isspace() else None
        if len(word) > LONGEST:
            return made
        if len(self) >= CACHE:
            self.clear()
        self[word] = made
        return made

    def raw(self, text: str) -> bytes:
        return np.array(self.plain.encode_ordinary(text), self.type).tobytes()

    def ids(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return (self.raw(first) if first else b"") + b"".join(map(self.__getitem__, rest))
        except TypeError:
            return self.raw(text)
