"""Pair scores inside groups from shared features, and fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.functions.text import similarity
from refweave.operators.graph import components
from refweave.sources.tables import cut

# Weights of feature types and offset of the pair classifier.
WEIGHTS = {"refstring": 0.72939795, "matchID": 0.0, "pubnumber": 0.36280852, "source": 0.56819319, "title": 7.3914298, "surname": -1.53487169, "init": 1.21194258, "first": 0.36810172, "editor": -0.67533247, "publisher": 0.15776101}
BIAS, THRESHOLD = -5.55875478, 0.1
# Part of a weight by which sums of doubles are surely less wrong.
SLACK = 1e-9


def shared_features(features: DataFrame) -> DataFrame:
    """(grp, a, b, ftype, shared): features two records of a group share, a < b.

    features: (grp, rec, ftype, value), distinct.
    """
    x, y = features.alias("x"), features.alias("y")
    same = (F.col("x.grp") == F.col("y.grp")) & (F.col("x.ftype") == F.col("y.ftype")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.rec") < F.col("y.rec"))
    return x.join(y, same).groupBy(F.col("x.grp").alias("grp"), F.col("x.rec").alias("a"), F.col("y.rec").alias("b"), F.col("x.ftype").alias("ftype")).agg(F.count("*").alias("shared"))


def type_similarities(features: DataFrame, kind: str | tuple[str, ...] = "jaccard") -> DataFrame:
    """(grp, a, b, ftype, sim) for the pairs and types that share a feature; of several kinds a column each, from one join."""
    features = cut(features.select("grp", "rec", "ftype", "value").distinct())
    sizes = features.groupBy("grp", "rec", "ftype").agg(F.count("*").alias("n"))
    side = lambda s: sizes.select("grp", F.col("rec").alias(s), "ftype", F.col("n").alias(f"n{s}"))
    pairs = shared_features(features).join(side("a"), ["grp", "a", "ftype"]).join(side("b"), ["grp", "b", "ftype"])
    of = lambda k, name: similarity(k, F.col("shared"), F.col("na"), F.col("nb")).alias(name)
    return pairs.select("grp", "a", "b", "ftype", *([of(kind, "sim")] if isinstance(kind, str) else [of(k, k) for k in kind]))


def pair_scores(features: DataFrame, weights: dict[str, float] = WEIGHTS, bias: float = BIAS, kind: str = "jaccard") -> DataFrame:
    """(grp, a, b, score): logistic score of the weighted similarities; pairs that share nothing have none."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("ftype"))
    total = F.sum(F.coalesce(weight, F.lit(0.0)) * F.col("sim")) + bias
    return type_similarities(features, kind).groupBy("grp", "a", "b").agg((1 / (1 + F.exp(-total))).alias("score"))


def linked_pairs(features: DataFrame, threshold: float = THRESHOLD, weights: dict[str, float] = WEIGHTS, bias: float = BIAS, kind: str = "jaccard") -> DataFrame:
    """(a, b): pairs of a group whose score exceeds the threshold.

    Where all other types together can't lift a pair over the threshold, it must be like in the weightiest type. Pairs are
    then looked for in that type only, so that a value that is common in another, such as a field that is empty, makes no
    pair, and the other types are compared within the pairs found, from one array of features per record.
    """
    top = max(weights, key=lambda t: weights[t])
    need = (math.log(threshold / (1 - threshold)) - bias - sum(w for t, w in weights.items() if w > 0 and t != top)) / weights[top]
    features = cut(features.select("grp", "rec", "ftype", "value").distinct())
    if need <= 0:
        return pair_scores(features, weights, bias, kind).where(F.col("score") > threshold).select("a", "b")
    met = type_similarities(features.where(F.col("ftype") == top), kind).where(F.col("sim") >= need).select("grp", "a", "b", F.col("sim").alias("first"))
    used = sorted(t for t, w in weights.items() if t != top and w)
    own = cut(features.where(F.col("ftype").isin(used)).groupBy("grp", "rec").agg(*[F.collect_list(F.when(F.col("ftype") == t, F.xxhash64("value"))).alias(t) for t in used]))
    side = lambda s: own.select("grp", F.col("rec").alias(s), *[F.col(t).alias(f"{t}_{s}") for t in used])
    both = cut(met).join(side("a"), ["grp", "a"], "left").join(side("b"), ["grp", "b"], "left")

    def sim(t: str) -> Column:
        x, y = F.col(f"{t}_a"), F.col(f"{t}_b")
        shared = F.size(F.array_intersect(x, y))
        return F.when(F.size(x) * F.size(y) * shared > 0, similarity(kind, shared, F.size(x), F.size(y))).otherwise(0.0)

    total = sum((weights[t] * sim(t) for t in used), F.lit(bias) + weights[top] * F.col("first"))
    return both.where(1 / (1 + F.exp(-total)) > threshold).select("a", "b")


def logistic_clusters(features: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """(rec, cluster): components of the pairs above the threshold within each group; the smallest record names one."""
    alone = features.select(F.col("rec").alias("a"), F.col("rec").alias("b")).distinct()
    return components(linked_pairs(features, threshold, **how).union(alone)).select(F.col("node").alias("rec"), F.col("component").alias("cluster"))


def simhash(features: DataFrame) -> DataFrame:
    """(rec, b0 .. b7): 64-bit majority fingerprint as eight bytes; a bit is set where half or more of the features have it.

    features: (rec, f). Feature bits are those of the first half of its MD5.
    """
    hashed = features.select("rec", "f").repartition("rec").distinct().withColumn("h", F.md5(F.col("f").cast("binary")))
    # Words of a record meet in one exchange, before 64 sums make each of them a wide row.
    values = hashed.select("rec", *[F.conv(F.substring("h", 2 * byte + 1, 2), 16, 10).cast("int").alias(f"v{byte}") for byte in range(8)])
    most = lambda byte, bit: 2 * F.sum(F.shiftright(f"v{byte}", bit).bitwiseAND(F.lit(1))) >= F.count("*")
    bits = [sum((F.when(most(byte, bit), F.lit(1 << bit)).otherwise(F.lit(0)) for bit in range(8)), F.lit(0)).alias(f"b{byte}") for byte in range(8)]
    return values.groupBy("rec").agg(*bits)


def hamming_pairs(prints: DataFrame, k: int = 7, blocks: int = 9) -> DataFrame:
    """(a, b, distance): fingerprints at most k bits apart, in blocks of bits of which two more than k are cut.

    By the pigeonhole at least two blocks are equal. Fingerprints meet on each pair of blocks, of about 14 bits together
    for 9 blocks, and a pair is kept at the first two blocks on which it agrees. Equal fingerprints meet once, as one;
    their records are linked to the smallest.
    """
    if blocks < k + 2:
        raise ValueError("two blocks must stay equal")
    sig = [f"b{i}" for i in range(8)]
    classes = cut(prints.groupBy(*sig).agg(F.min("rec").alias("rec")))
    whole = sum((F.shiftleft(F.col(f"b{i}").cast("long"), 8 * i) for i in range(8)), F.lit(0).cast("long"))
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = lambda i, bits: F.shiftrightunsigned(bits, ends[i]).bitwiseAND(F.lit((1 << (ends[i + 1] - ends[i])) - 1))
    # The bits of both blocks in one long; a block has 32 at most, where two are all there are.
    wide = max(ends[i + 1] - ends[i] for i in range(blocks))
    two = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.shiftleft(part(i, "bits"), wide).bitwiseOR(part(j, "bits")).alias("same")) for j in range(blocks) for i in range(j)]
    keyed = classes.select("rec", whole.alias("bits")).select("rec", "bits", F.explode(F.array(*two)).alias("at")).select("rec", "bits", "at.*")
    x, y = keyed.alias("x"), keyed.alias("y")
    differ = F.col("x.bits").bitwiseXOR(F.col("y.bits"))
    earlier = sum((((F.col("x.j") > p) & (part(p, differ) == 0)).cast("int") for p in range(blocks)), F.lit(0))
    away = F.bit_count(differ)
    same = (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & (F.col("x.same") == F.col("y.same"))
    # Merge joins: the file of the prints tells nothing of the pairs of blocks that are made of each of them.
    near = x.join(y.hint("merge"), same & (F.col("x.rec") < F.col("y.rec")) & (away <= k) & (earlier == 1))
    apart = near.select(F.col("x.rec").alias("a"), F.col("y.rec").alias("b"), away.alias("distance"))
    equal = prints.join(classes.withColumnRenamed("rec", "a").hint("merge"), sig).where("a < rec").select("a", F.col("rec").alias("b"), F.lit(0).alias("distance"))
    return apart.union(equal)


def smoothing(features: DataFrame, least: float = 0.5) -> DataFrame:
    """(f, g, weight): how much of feature f stands for g by the records (rec, f) that have both.

    Each record with both gives 1 over its number of features and over the frequency of g; a row is scaled by its own
    diagonal, and what stays under ``least`` is left out. A record gives the square of its few features. Records are
    counted by size, so that no sum depends on order, and whole numbers decide what rounding can't tell from ``least``.
    """
    features = cut(features.select("rec", "f").distinct())
    size = features.groupBy("rec").agg(F.count("*").alias("size"))
    freq = features.groupBy("f").agg(F.count("*").alias("freq"))
    sized = features.join(size, "rec")

    def met(rows: DataFrame, by: list[str]) -> DataFrame:
        sizes = rows.groupBy(*by, "size").agg(F.count("*").alias("n"))
        return sizes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("met"))

    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x["n"] / x["size"])
    both = met(sized.join(features.withColumnRenamed("f", "g"), "rec"), ["f", "g"]).join(freq.withColumnRenamed("f", "g"), "g")
    own = met(sized, ["f"]).join(freq, "f").select("f", F.col("met").alias("own"), F.col("freq").alias("rows"))
    weight = total("met") / F.col("freq") / (total("own") / F.col("rows"))
    kept = cut(both.join(own, "f").withColumn("weight", weight).where(F.col("weight") >= least * (1 - SLACK)))
    beyond = F.col("weight") > least * (1 + SLACK)
    limit = Fraction(str(least))

    def at_least(row) -> bool:
        common = math.lcm(*[int(x["size"]) for x in row.own])
        given, most = (sum(common // int(x["size"]) * int(x["n"]) for x in xs) for xs in (row.met, row.own))
        return given * int(row.rows) * limit.denominator >= most * int(row.freq) * limit.numerator

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.loc[[at_least(row) for row in p.itertuples()], ["f", "g", "weight"]]

    out = ["f", "g", "weight"]
    return kept.where(beyond).select(out).union(kept.where(~beyond).mapInPandas(run, kept.select(out).schema))


def dbscan(pairs: DataFrame, nodes: DataFrame, eps: float, least: int = 3) -> DataFrame:
    """(rec, cluster) by density: pairs (a, b, sim) at a distance 1 - sim^2 of eps or less are neighbours.

    A record with ``least`` neighbours, itself counted, is a core; linked cores are one cluster, named by the smallest;
    a neighbour of a core belongs to the smallest of their clusters; all others have null.
    """
    near = cut(pairs.where(1 - F.col("sim") * F.col("sim") <= eps).select("a", "b"))
    both = cut(near.union(near.select("b", "a")).distinct())
    core = cut(both.groupBy("a").agg((F.count("*") + 1).alias("n")).where(F.col("n") >= least).select("a"))
    linked = both.join(core, "a").join(core.withColumnRenamed("a", "b"), "b").select("a", "b")
    alone = core.select("a", F.col("a").alias("b"))
    groups = cut(components(linked.union(alone)))
    beside = both.join(groups.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("rec")).agg(F.min("component").alias("beside"))
    return nodes.select("rec").distinct().join(groups.withColumnRenamed("node", "rec"), "rec", "left").join(beside, "rec", "left").select("rec", F.coalesce("component", "beside").alias("cluster"))


def fnv1a(texts: list[str]) -> np.ndarray:
    """64-bit FNV-1a over the UTF-8 bytes of each text, all texts a byte at a time."""
    data = [t.encode() for t in texts]
    # Offset and prime of the hash.
    out, prime = np.full(len(data), 0xCBF29CE484222325, np.uint64), np.uint64(0x100000001B3)
    size = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(b"".join(data), np.uint8)
    start = np.cumsum(size) - size
    for k in range(int(size.max()) if len(size) else 0):
        at = np.flatnonzero(size > k)
        out[at] = (out[at] ^ flat[start[at] + k].astype(np.uint64)) * prime
    return out


def hashed_words(words: DataFrame) -> DataFrame:
    """(word, hash): the hash of each word (word) as hexadecimal digits."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"word": p["word"], "hash": [f"{x:016x}" for x in fnv1a(p["word"].tolist()).tolist()]})

    return words.mapInPandas(run, "word string, hash string")
