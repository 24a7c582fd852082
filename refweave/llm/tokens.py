"""Sizes of texts in tokens of a public byte-level tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# The vocabulary's own rule for cutting a text into pieces: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORD, CACHED_WORDS = 64, 400_000


@lru_cache(4)
def encoding(folder: str = TOKENIZERS, name: str = VOCABULARY):
    """The tokenizer in a file of token ranks."""
    import tiktoken

    with (Path(folder) / name).open("rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Counts(dict):
    """Tokens of a word with the space before it; a space that a word follows always begins a piece."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> int:
        n = len(self.encode(" " + word))
        if len(word) <= CACHED_WORD:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n


@lru_cache(4)
def _counts(folder: str, name: str) -> _Counts:
    return _Counts(encoding(folder, name).encode_ordinary)


def count_tokens(text: str | None, folder: str = TOKENIZERS, name: str = VOCABULARY) -> int:
    """Tokens of a text; 0 for null and for the empty text."""
    if not text:
        return 0
    counts = _counts(folder, name)
    first, *rest = text.split(" ")
    if not first or "" in rest or any(w[0].isspace() for w in rest):
        # Spaces beside other white space share pieces with it: no cutting there.
        return len(counts.encode(text))
    return len(counts.encode(first)) + sum(map(counts.__getitem__, rest))


def with_tokens(documents: DataFrame, text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``tokens`` of every row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes = np.fromiter((count_tokens(t, folder, name) for t in part.pop("__text")), np.int64, len(part))
            yield part.assign(tokens=sizes)

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*keep, documents[text].cast("string").alias("__text")).mapInPandas(run, schema + ", tokens long")
