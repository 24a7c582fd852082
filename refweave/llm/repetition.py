"""Repetition inside a single document (problem 10).

Texts are taken in batches as one array of code points. Words are the longest
runs of letters, lower-cased; a rolling polynomial hash gives every word and,
over the words, every n-gram in a few array operations. A word is covered when
it lies in an n-gram that occurred at an earlier place of the same text.
Duplicate lines and paragraphs are measured in characters in the same way.

Defined cases: null and empty texts and texts without a letter have share 0;
texts shorter than n words have share 0 for that n; a text of any length is
taken whole; equal texts and repeated rows each give a row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from refweave.llm.bagminhash import mix

BATCH_CHARS = 2_000_000


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and its lower case."""
    top = 0x110000
    letter, lower = np.zeros(top, bool), np.arange(top, dtype=np.uint32)
    for code in [*range(0x3400), *range(0xA000, 0xD800), *range(0xE000, 0x20000)]:
        c = chr(code)
        if unicodedata.category(c)[0] == "L":
            letter[code] = True
            if len(low := c.lower()) == 1:
                lower[code] = ord(low)
    letter[0x3400:0x4DC0] = letter[0x4E00:0xA000] = letter[0x20000:0x323B0] = True
    return letter, lower


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters after one another, each text followed by a zero; and where each text starts."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return codes, np.concatenate(([0], np.cumsum(sizes)))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def _segment_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for each segment, from one prefix sum."""
    if not len(start):
        return np.empty(0, np.uint64)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(codes.astype(np.uint64)) * _powers(_BASE, len(codes)), dtype=np.uint64)))
    back = _powers(_INVERSE, len(codes) + 1)
    return mix((prefix[end] - prefix[start]) * back[start] ^ (end - start).astype(np.uint64))


def words_of(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash, start and end of every word."""
    letter, lower = _tables()
    is_letter = letter[codes]
    edge = np.diff(np.concatenate(([0], is_letter.view(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return np.searchsorted(starts, begin, "right") - 1, _segment_hashes(lower[codes], begin, end), begin, end


def later_copies(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Whether an equal item stands at an earlier place of the same text."""
    key = mix(item ^ mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again


def ngram_coverage(doc: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """For every word whether it lies in a run of n words that occurred earlier in its text."""
    covered = np.zeros(len(word) + 1, np.int64)
    if len(word) >= n:
        grams = mix(word[: len(word) - n + 1].copy())
        for k in range(1, n):
            grams = mix(grams ^ word[k : len(word) - n + 1 + k])
        own = np.flatnonzero(doc[: len(grams)] == doc[n - 1 :])
        hits = own[later_copies(doc[own], grams[own])]
        np.add.at(covered, hits, 1)
        np.add.at(covered, hits + n, -1)
    return np.cumsum(covered)[:-1] > 0


def _measured(texts: list[str], lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    codes, starts = _code_points(texts)
    doc, word, begin, end = words_of(codes, starts)
    words = np.bincount(doc, minlength=len(texts))
    chars = np.bincount(doc, end - begin, minlength=len(texts))
    out: dict[str, np.ndarray] = {"words": words}
    for n in lengths:
        covered = ngram_coverage(doc, word, n)
        out[f"words_in_repeated_{n}"] = np.bincount(doc[covered], minlength=len(texts)) / np.maximum(1, words)
        out[f"chars_in_repeated_{n}"] = np.bincount(doc[covered], (end - begin)[covered], minlength=len(texts)) / np.maximum(1, chars)
    breaks = np.flatnonzero((codes == 10) | (codes == 0))
    line_start = np.concatenate(([0], breaks[:-1] + 1)) if len(breaks) else np.empty(0, np.int64)
    filled = breaks > line_start
    line_start, line_end = line_start[filled], breaks[filled]
    line_doc = np.searchsorted(starts, line_start, "right") - 1
    again = later_copies(line_doc, _segment_hashes(codes, line_start, line_end))
    size = line_end - line_start
    out["chars_in_repeated_lines"] = np.bincount(line_doc[again], size[again], minlength=len(texts)) / np.maximum(1, np.bincount(line_doc, size, minlength=len(texts)))
    return out


def batches_of(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[slice]:
    """Slices of at most so many characters, or one longer text."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > limit:
            yield slice(start, i)
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def repetition(documents: DataFrame, key: str = "doc_id", text: str = "text", lengths: tuple[int, ...] = (3, 5, 8, 12)) -> DataFrame:
    """Shares of repeated words, characters and lines of every document, without a shuffle."""
    names = [f"{kind}_in_repeated_{n}" for n in lengths for kind in ("words", "chars")] + ["chars_in_repeated_lines"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["text"].fillna("").tolist()
            for piece in batches_of(texts):
                yield pd.DataFrame({"key": part["key"].to_numpy()[piece], **_measured(texts[piece], lengths)})[["key", "words", *names]]

    kind = documents.schema[key].dataType.simpleString()
    return documents.selectExpr(f"`{key}` as key", f"cast(`{text}` as string) as text").mapInPandas(run, f"key {kind}, words long, " + ", ".join(f"{n} double" for n in names)).withColumnRenamed("key", key)
