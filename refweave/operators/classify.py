"""Rule-based pair classifier: optimal assignment of field values by common substrings.

Pairs come in Arrow batches; what is costly per pair (matching blocks, the
assignment) runs in plain Python, everything before it in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from refweave.operators.graph import components

NOT_WORD = re.compile(r"\W+")
# What counts as a year, and the bounds and weight of the pair classifier.
YEAR = re.compile(r"1[5-9][0-9]{2}|20(0[0-9]|1[0-9]|2[0-3])")
MAX_COST, MIN_PRECISION, MAX_TITLE_DIFFERENCE, YEAR_WEIGHT = 0.25, 0.85, 0.5, 250


def common(a: str, b: str, least: int = 1) -> int:
    """Characters in matching blocks of at least the given size."""
    return sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks() if m.size >= least)


def difference(a: str, b: str) -> float:
    """1 less the part of the longer string that the blocks in common make up."""
    longer = max(len(a), len(b))
    return 1 - common(a.lower(), b.lower()) / longer if longer else 0.0


def cost(a: str, b: str) -> int:
    """Letters of the shorter string outside blocks of two or more, other characters aside."""
    a, b = ("_" + NOT_WORD.sub("", s.lower()) for s in (a, b))
    return min(len(a), len(b)) - common(a, b, 2)


def assignment(costs: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost: shortest augmenting paths with potentials; the lower column on a tie."""
    flip = costs.shape[0] > costs.shape[1]
    c = costs.T if flip else costs
    n, m = c.shape
    row_of = np.full(m, -1)
    u, v = np.zeros(n), np.zeros(m)
    for start in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col, low = start, -1, 0.0
        while True:
            reduced = low + c[row] - u[row] - v
            better = ~done & (reduced < dist)
            dist[better], via[better] = reduced[better], col
            open_dist = np.where(done, np.inf, dist)
            col = int(open_dist.argmin())
            low = open_dist[col]
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        u[start] += low
        for j in np.flatnonzero(done):
            if row_of[j] >= 0:
                u[row_of[j]] += low - dist[j]
            v[j] -= low - dist[j]
        while col >= 0:
            before = via[col]
            row_of[col] = row_of[before] if before >= 0 else start
            col = before
    pairs = [(int(r), j) for j, r in enumerate(row_of) if r >= 0]
    return sorted((j, r) for r, j in pairs) if flip else sorted(pairs)


def similar(a: str, b: str, price: float) -> bool:
    if YEAR.fullmatch(a) and YEAR.fullmatch(b):
        return abs(int(a) - int(b)) <= 1
    return price / max(1, min(len(a), len(b))) < MAX_COST


def equivalent(left: dict[str, list[str]], right: dict[str, list[str]]) -> bool:
    """Whether two records of field -> values are one: titles alike, and what can be assigned mostly agrees."""
    if not left.get("title") or not right.get("title") or difference(left["title"][0], right["title"][0]) >= MAX_TITLE_DIFFERENCE:
        return False
    agreed = differed = matches = 0
    for field in left.keys() & right.keys():
        a, b = left[field], right[field]
        if not a or not b:
            continue
        costs = np.array([[float(cost(x, y)) for y in b] for x in a])
        for i, j in assignment(costs):
            weight = YEAR_WEIGHT if field == "year" else min(len(a[i]), len(b[j]))
            if similar(a[i], b[j], costs[i, j]):
                agreed += weight
                matches += 1
            else:
                differed += weight
    return matches > 1 and agreed / max(1, agreed + differed) >= MIN_PRECISION


def fields(df: DataFrame, columns: dict[str, list[Column] | Column]) -> Column:  # noqa: ARG001
    """A struct of the values of every field, without sentinels; an array column holds the values of its field."""
    values = lambda cs: F.array(*[c.cast("string") for c in cs]) if isinstance(cs, list) else cs
    kept = lambda cs: F.filter(F.array_compact(values(cs)), lambda x: ~F.trim(x).isin("None", ""))
    return F.struct(*[kept(cs).alias(name) for name, cs in columns.items()])


def classified(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b, same_id, left, right) that are equivalent; left and right from ``fields``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            plain = lambda r: {k: list(v) for k, v in r.items() if v is not None and len(v)}
            keep = [equivalent(plain(x), plain(y)) for x, y in zip(part["left"], part["right"], strict=True)]
            yield part.loc[keep, ["a", "b"]]

    by_id = pairs.where("same_id").select("a", "b")
    # Blocks in common are no longer than the shorter title: what differs too much in length needs no look.
    x, y = F.length(F.get("left.title", F.lit(0))), F.length(F.get("right.title", F.lit(0)))
    near = pairs.where("not same_id").where((F.least(x, y) > 0) & (1 - F.least(x, y) / F.greatest(x, y) < MAX_TITLE_DIFFERENCE))
    return by_id.union(near.select("a", "b", "left", "right").mapInPandas(run, "a long, b long"))


def duplicates(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rec, duplicate): transitive closure of the equivalent pairs; every member has a group."""
    alone = members.select(F.col("rec").alias("a"), F.col("rec").alias("b")).distinct()
    return components(classified(pairs).union(alone)).select(F.col("node").alias("rec"), F.col("component").alias("duplicate"))


@pandas_udf(DoubleType())
def title_difference(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difference(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def simple_rule(a_title: Column, b_title: Column, a_year: Column, b_year: Column, a_names: Column, b_names: Column, title_least: float = 0.75, name_least: float = 0.5) -> Column:
    """The plain rule: years at most one apart, titles and names of enough overlap of 3-grams; what is absent isn't compared."""
    from refweave.functions.text import ngrams

    def overlap(x: Column, y: Column) -> Column:
        gx, gy = F.array_distinct(ngrams(x, 3)), F.array_distinct(ngrams(y, 3))
        return F.size(F.array_intersect(gx, gy)) / F.nullif(F.least(F.size(gx), F.size(gy)), F.lit(0))

    years = F.coalesce(F.abs(a_year - b_year) <= 1, F.lit(True))
    return years & F.coalesce(overlap(a_title, b_title) >= title_least, F.lit(False)) & F.coalesce(overlap(a_names, b_names) >= name_least, F.lit(True))


def _each(kind: str):
    """A column function of two text columns, null where one of them is."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _MEASURES[kind](x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return pandas_udf(run, DoubleType())


_MEASURES = {
    "unmatched": lambda a, b: float(max(len(a), len(b)) - common(a.lower(), b.lower())),
    "cost": lambda a, b: float(cost(a, b)),
    "similar": lambda a, b: float(similar(a, b, cost(a, b))),
    "assigned": lambda a, b: float(sum(c for c in _assigned_costs(NOT_WORD.split(a), NOT_WORD.split(b)))),
}


def _assigned_costs(a: list[str], b: list[str]) -> list[float]:
    """Costs of the optimal assignment of the non-empty parts of two names."""
    a, b = [x for x in a if x], [x for x in b if x]
    if not a or not b:
        return []
    costs = np.array([[float(cost(x, y)) for y in b] for x in a])
    return [costs[i, j] for i, j in assignment(costs)]


def measured(kind: str, a: Column, b: Column) -> Column:
    """Of two texts: characters of the longer outside common blocks (``unmatched``), ``cost``, whether they are ``similar``
    enough at that cost, or the least total cost of their parts (``assigned``)."""
    return _each(kind)(a, b)
