"""Near-duplicate records with small edits (problem 5): BagMinHash.

A record is a multiset of features (character sequences or word shingles).
Every feature owns Poisson processes over its weight range, one per dyadic
interval (0,1], (1,2], (2,4], (4,8] ... of the discretised weight; a record
takes the points of an interval that lie below the feature's weight. Each point
falls into one register, a register keeps its earliest point, and two records
agree in a register with a probability equal to their weighted Jaccard
similarity. Points come in order of time, so a feature stops as soon as its
next point is later than every register of the record: the cost is about
features + registers * log(registers), not their product.

Signatures are cut into bands; band rows carry a 128-bit sketch of the
signature, so that the rows of a bucket are compared without any text, and the
pairs that remain are verified on the texts themselves.

Defined cases: records of equal text are one member each of the same class and
are hashed once; null and featureless records take no part; a feature's weight
is its count (``weighted``) or 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.sources.tables import cut

REGISTERS, BANDS = 80, 20
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    a, b, c = (np.uint64(m) for m in _MULTIPLIERS)
    x = x + a
    x = (x ^ (x >> np.uint64(30))) * b
    x = (x ^ (x >> np.uint64(27))) * c
    return x ^ (x >> np.uint64(31))


def char_features(texts: list[str], n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Record number and feature of every sequence of n characters."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    if len(codes) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    packed = codes[: len(codes) - n + 1].copy()
    for k in range(1, n):
        packed = (packed << np.uint64(21)) | codes[k : len(codes) - n + 1 + k] if n <= 3 else mix(packed) ^ codes[k : len(codes) - n + 1 + k]
    same = doc[: len(packed)] == doc[n - 1 :]
    return doc[: len(packed)][same], packed[same]


def word_features(texts: list[str], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Record number and feature of every shingle of n words; a shorter text is one shingle."""
    words, sizes = [], np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.split()
        sizes[i] = len(own)
        words += own
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashed = pd.util.hash_array(np.array(words, dtype=object), categorize=True)
    doc = np.repeat(np.arange(len(texts)), sizes)
    start = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    left = sizes[doc] - (np.arange(len(words)) - start[doc])
    keep = (left >= n) | (np.arange(len(words)) == start[doc])
    at = np.flatnonzero(keep)
    out = mix(np.zeros(len(at), np.uint64))
    for k in range(n):
        there = left[at] > k
        out = np.where(there, mix(out ^ hashed[np.minimum(at + k, len(words) - 1)]), out)
    return doc[at], out


def signatures(doc: np.ndarray, feature: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """docs x registers of float64; infinite where a record has no feature.

    doc, feature: one row per distinct feature of a record; weight: its
    discretised weight, at least 1.
    """
    sig = np.full(docs * registers, np.inf)
    if len(doc):
        levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
        for level in range(int(levels.max()) + 1):
            low, high = (0, 1) if level == 0 else (2 ** (level - 1), 2**level)
            in_level = levels >= level
            d, w = doc[in_level], weight[in_level]
            state = mix(feature[in_level] ^ np.uint64(0xA5A5_0000 + level))
            t = np.zeros(len(d))
            rate = float((high - low) * registers)
            while len(d):
                state = mix(state)
                t = t - np.log1p(-(state >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
                late = sig.reshape(docs, registers).max(axis=1)
                live = t < late[d]
                d, w, t, state = d[live], w[live], t[live], state[live]
                if not len(d):
                    break
                place = mix(state ^ np.uint64(0x5851F42D4C957F2D))
                spot = d * registers + (place % np.uint64(registers)).astype(np.int64)
                if level:
                    inside = low + (place >> np.uint64(40)).astype(np.float64) * 2.0**-24 * (high - low) < w
                    np.minimum.at(sig, spot[inside], t[inside])
                else:
                    np.minimum.at(sig, spot, t)
    return sig.reshape(docs, registers)


def _counted(doc: np.ndarray, feature: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not weighted:
        # The earliest point of a repeated feature is its own again, so that duplicates needn't be removed.
        return doc, feature, np.ones(len(doc), np.int64)
    order = np.lexsort((feature, doc))
    d, f = doc[order], feature[order]
    first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (f[1:] != f[:-1])))) if len(d) else np.empty(0, np.int64)
    return d[first], f[first], np.diff(np.concatenate((first, [len(d)])))


def _banded(features: str, n: int, weighted: bool, registers: int, bands: int):
    rows = registers // bands

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 2000):
                part = whole.iloc[start : start + 2000]
                doc, feature = (char_features if features == "chars" else word_features)(part["text"].tolist(), n)
                sig = signatures(*_counted(doc, feature, weighted), len(part), registers)
                full = np.isfinite(sig).all(axis=1)
                bits = mix(sig[full].view(np.uint64))
                keys = np.zeros((len(bits), bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys ^ bits[:, r::rows][:, :bands])
                keys ^= mix(np.arange(bands, dtype=np.uint64))
                shifts = np.arange(min(64, registers), dtype=np.uint64)
                low = ((bits[:, :64] & np.uint64(1)) << shifts).sum(axis=1, dtype=np.uint64)
                high = (((bits[:, :64] >> np.uint64(1)) & np.uint64(1)) << shifts).sum(axis=1, dtype=np.uint64)
                ids = part["id"].to_numpy()[full]
                yield pd.DataFrame({
                    "band": keys.T.reshape(-1).view(np.int64),
                    "id": np.tile(ids, bands),
                    "low": np.tile(low.view(np.int64), bands),
                    "high": np.tile(high.view(np.int64), bands),
                })

    return run


MATRIX_BYTES = 32_000_000


def _jaccard(extract, texts_a: list[str], texts_b: list[str]) -> np.ndarray:
    """Exact Jaccard similarity of the feature sets of each pair, from one row of bits per text."""
    number: dict[str, int] = {}
    a = np.fromiter((number.setdefault(t, len(number)) for t in texts_a), np.int64, len(texts_a))
    b = np.fromiter((number.setdefault(t, len(number)) for t in texts_b), np.int64, len(texts_b))
    doc, feature = extract(list(number))
    code, known = pd.factorize(feature)
    words = len(known) // 64 + 1
    if 8 * len(number) * words > MATRIX_BYTES and len(texts_a) > 1:
        half = len(texts_a) // 2
        return np.concatenate((_jaccard(extract, texts_a[:half], texts_b[:half]), _jaccard(extract, texts_a[half:], texts_b[half:])))
    bits = np.zeros(len(number) * words, np.uint64)
    np.bitwise_or.at(bits, doc * words + (code >> 6), np.uint64(1) << (code & 63).astype(np.uint64))
    bits = bits.reshape(len(number), words)
    sizes = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    shared = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64)
    return shared / np.maximum(1, sizes[a] + sizes[b] - shared)


PAIR_FEATURES = 2_000_000


def _weighted_jaccard(extract, texts_a: list[str], texts_b: list[str]) -> np.ndarray:
    """Exact weighted Jaccard similarity of the feature multisets of each pair, by sorting both sides' features together."""
    number: dict[str, int] = {}
    a = np.fromiter((number.setdefault(t, len(number)) for t in texts_a), np.int64, len(texts_a))
    b = np.fromiter((number.setdefault(t, len(number)) for t in texts_b), np.int64, len(texts_b))
    doc, feature, count = _counted(*extract(list(number)), True)
    code, known = pd.factorize(feature)
    at = np.searchsorted(doc, np.arange(len(number) + 1))
    size, total = np.diff(at), np.bincount(doc, count, minlength=len(number))
    out = np.empty(len(a))
    begin = 0
    ahead = np.cumsum(size[a] + size[b])
    while begin < len(a):
        end = max(begin + 1, int(np.searchsorted(ahead, (ahead[begin - 1] if begin else 0) + PAIR_FEATURES, "right")))
        sides = np.concatenate((a[begin:end], b[begin:end]))
        pair = np.repeat(np.tile(np.arange(end - begin), 2), size[sides])
        own = np.arange(len(pair)) - np.repeat(np.cumsum(size[sides]) - size[sides], size[sides]) + np.repeat(at[sides], size[sides])
        key = pair * max(1, len(known)) + code[own]
        order = np.argsort(key, kind="stable")
        both = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        least = np.minimum(count[own[order[both]]], count[own[order[both + 1]]])
        shared = np.bincount(pair[order[both]], least, minlength=end - begin)
        out[begin:end] = shared / np.maximum(1, total[a[begin:end]] + total[b[begin:end]] - shared)
        begin = end
    return out


def _verified(features: str, n: int, weighted: bool, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 2500):
                part = whole.iloc[start : start + 2500]
                extract = lambda t: (char_features if features == "chars" else word_features)(t, n)
                sims = (_weighted_jaccard if weighted else _jaccard)(extract, part["text_a"].tolist(), part["text_b"].tolist())
                keep = sims >= threshold - 1e-12
                yield pd.DataFrame({"a": part["a"].to_numpy()[keep], "b": part["b"].to_numpy()[keep], "similarity": sims[keep]})

    return run


def normal_text(text: Column) -> Column:
    """Lower case, every run of characters other than letters and digits as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def similar_pairs(texts: DataFrame, features: str = "chars", n: int = 3, threshold: float = 0.7, weighted: bool = False, registers: int = REGISTERS, bands: int = BANDS) -> DataFrame:
    """Pairs (a, b, similarity), a < b, of ids whose texts reach the threshold.

    texts: (id bigint, text string), each text once.
    """
    banded = texts.mapInPandas(_banded(features, n, weighted, registers, bands), "band long, id long, low long, high long")
    # Registers that agree in two bits: certain for an equal register, one in four for another. 3 standard deviations of leeway.
    m = min(64, registers)
    expected = threshold + (1 - threshold) / 4
    least = int(m * expected - 3 * (m * expected * (1 - expected)) ** 0.5)
    agree = m - F.bit_count(F.col("x.low").bitwiseXOR(F.col("y.low")).bitwiseOR(F.col("x.high").bitwiseXOR(F.col("y.high"))))
    pairs = (
        banded.alias("x").join(banded.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.id") < F.col("y.id")) & (agree >= least))
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    )
    # A table: what was shuffled for the bands is gone before any text moves.
    pairs = cut(pairs.distinct())
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInPandas(_verified(features, n, weighted, threshold), "a long, b long, similarity double")
