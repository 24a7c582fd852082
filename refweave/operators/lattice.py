"""Generalisation of feature bundles, and agglomeration on lattices."""

from __future__ import annotations

from itertools import combinations, product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.operators.graph import components
from refweave.sources.tables import cut, drop


def parse_rules(text: str) -> dict[tuple[tuple[str, int], ...], list[dict[str, int]]]:
    """``2 surname 1 year --> 1 surname 1 year | 2 surname`` per line, as counts by feature type."""
    rules: dict = {}

    def counts(side: str) -> dict[str, int]:
        words = side.split()
        return {t: int(n) for n, t in zip(words[::2], words[1::2], strict=True) if int(n)}

    for line in text.splitlines():
        if "-->" in line:
            left, right = line.split("-->")
            rules.setdefault(tuple(sorted(counts(left).items())), []).extend(counts(r) for r in right.split("|"))
    return rules


def general_forms(bundle: dict[str, list[str]], rules: dict) -> list[dict[str, list[str]]]:
    """Every bundle that a rule makes by leaving features out."""
    have = tuple(sorted((t, len(v)) for t, v in bundle.items() if v))
    out = []
    for target in rules.get(have, []):
        choices = [[(t, list(c)) for c in combinations(v, target[t])] if t in target else [(t, [])] for t, v in sorted(bundle.items())]
        out += [{t: v for t, v in pick if v} for pick in product(*choices)]
    return out


def generalized(bundles: DataFrame, rules: dict, types: list[str]) -> DataFrame:
    """(rep, <types as arrays>): the general forms of every bundle (rep, <types>)."""
    schema = "rep string, " + ", ".join(f"`{t}` array<string>" for t in types)

    def run(parts):
        for part in parts:
            rows = []
            for r in part.to_dict("records"):
                own = {t: list(r[t]) for t in types if r[t] is not None}
                rows += [{"rep": r["rep"], **{t: g.get(t) for t in types}} for g in general_forms(own, rules)]
            yield pd.DataFrame(rows, columns=["rep", *types])

    return bundles.select("rep", *types).mapInPandas(run, schema)


def level_of_generalization(edges: DataFrame, starts: DataFrame, max_level: int = 50) -> DataFrame:
    """(start, rep, level): every set that a start contains, directly or through others, at its least distance.

    edges: (sub, sup) covers; starts: (start, rep).
    """
    reached = cut(starts.select("start", "rep", F.lit(0).alias("level")))
    frontier = reached
    for level in range(1, max_level + 1):
        down = frontier.join(edges.withColumnRenamed("sup", "rep"), "rep").select("start", F.col("sub").alias("rep")).distinct()
        frontier = cut(down.join(reached, ["start", "rep"], "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            return reached
        reached = reached.union(frontier)
    raise ValueError("a chain of sets is longer than max_level")


def agglomerated(nodes: DataFrame, edges: DataFrame, stop: float = 0.5, discount: float = 0.0) -> DataFrame:
    """(rep, merged): nodes (rep, obs, size) merged along edges (sub, sup) whose weight exceeds a falling threshold.

    The weight is the count of the special over that of the general set, each with the counts of the sets right above
    it. In a round the ends of all edges above the threshold are merged at once, component by component, into the
    largest set, the smaller id on a tie; levels that no edge exceeds are passed over. Every round is a few joins over
    all lattices together, so that none is too large.
    """
    nodes, edges = cut(nodes.select("rep", F.col("obs").cast("double").alias("obs"), "size")), cut(edges.select("sub", "sup").distinct())
    merged = cut(nodes.select("rep", F.col("rep").alias("merged")))
    level, last = 99, round(stop * 100)
    while level >= last:
        over = edges.join(nodes.select(F.col("rep").alias("sup"), "obs"), "sup").groupBy(F.col("sub").alias("rep")).agg(F.sum("obs").alias("over"))
        car = nodes.join(over, "rep", "left").select("rep", (F.col("obs") + F.coalesce("over", F.lit(0.0))).alias("car"))
        both = edges.join(car.select(F.col("rep").alias("sub"), F.col("car").alias("below")), "sub").join(car.select(F.col("rep").alias("sup"), F.col("car").alias("above")), "sup")
        weighted = cut(both.where("below > 0").select("sub", "sup", (F.col("above") / F.col("below")).alias("weight")))
        top = weighted.agg(F.max("weight")).first()[0]
        while level >= last and not (top is not None and top > level / 100):
            level -= 1
        if level < last:
            drop(weighted)
            break
        groups = components(weighted.where(F.col("weight") > level / 100).select(F.col("sub").alias("a"), F.col("sup").alias("b")))
        known = groups.join(nodes, groups["node"] == nodes["rep"]).select("rep", "component", "size")
        best = known.groupBy("component").agg(F.min(F.struct((-F.col("size")).alias("s"), "rep"))["rep"].alias("keep"))
        moved = cut(known.join(best, "component").select("rep", "keep"))
        to = lambda old, name: moved.select(F.col("rep").alias(old), F.col("keep").alias(name))  # noqa: E731, B023
        at = nodes.join(moved, "rep", "left").withColumn("keep", F.coalesce("keep", "rep"))
        own = F.col("keep") == F.col("rep")
        kept = cut(at.groupBy(F.col("keep").alias("rep")).agg(F.sum(F.when(own, F.col("obs")).otherwise(F.col("obs") * (1 - discount))).alias("obs"), F.max(F.when(own, F.col("size"))).alias("size")))
        ends = edges.join(to("sub", "x"), "sub", "left").join(to("sup", "y"), "sup", "left").select(F.coalesce("x", "sub").alias("sub"), F.coalesce("y", "sup").alias("sup"))
        joined, now = cut(ends.where("sub <> sup").distinct()), cut(merged.join(to("merged", "keep"), "merged", "left").select("rep", F.coalesce("keep", "merged").alias("merged")))
        for done in (nodes, edges, merged, weighted, moved):
            drop(done)
        nodes, edges, merged = kept, joined, now
        level -= 1
    return merged


def licensed(features: Column, needs: dict[str, list[str]], bars: dict[str, list[str]]) -> Column:
    """Whether a set of feature types, as an array, has all that its members need and nothing that they bar."""
    ok = F.size(features) >= 2
    for t, others in needs.items():
        for o in others:
            ok &= ~F.array_contains(features, t) | F.array_contains(features, o)
    for t, others in bars.items():
        for o in others:
            ok &= ~(F.array_contains(features, t) & F.array_contains(features, o))
    return ok


def expanded(sets: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(fs, obs, car): every non-empty part of the sets (fs, obs), by leaving out one feature at a time.

    obs: the count of the set itself, 0 where it was never seen; car: the counts of all sets that it is part of, each
    once, itself included.
    """
    sets = cut(sets.select(F.array_sort(F.array_distinct("fs")).alias("fs"), "obs").where("size(fs) > 0").groupBy("fs").agg(F.sum("obs").alias("obs")))
    reached = now = sets.select(F.col("fs").alias("whole"), "fs")
    for _ in range(max_rounds):
        drop_one = F.explode(F.transform("fs", lambda x: F.array_remove("fs", x)))
        now = cut(now.where("size(fs) > 1").select("whole", drop_one.alias("fs")).distinct())
        if now.isEmpty():
            break
        reached = reached.union(now)
    else:
        raise ValueError("a set has more features than max_rounds")
    car = reached.join(sets.withColumnRenamed("fs", "whole"), "whole").groupBy("fs").agg(F.sum("obs").alias("car"))
    return car.join(sets, "fs", "left").select("fs", F.coalesce("obs", F.lit(0)).alias("obs"), "car")


def discounted(nodes: DataFrame, edges: DataFrame, part: float) -> DataFrame:
    """(rep, obs): a part of every count handed on along the edges (sub, sup) and to the set itself.

    nodes: (rep, obs, car). An edge weighs the count carried by its special over that carried by its general set, a set's
    own share its observed over its carried count; what a set gives is divided by these weights.
    """
    nodes = cut(nodes.select("rep", F.col("obs").cast("double").alias("obs"), F.col("car").cast("double").alias("car")))
    side = lambda end, car: nodes.select(F.col("rep").alias(end), F.col("car").alias(car))
    up = edges.select("sub", "sup").distinct().join(side("sub", "below"), "sub").join(side("sup", "above"), "sup").where("below > 0")
    weights = up.select("sub", "sup", (F.col("above") / F.col("below")).alias("w")).union(nodes.where("car > 0").select("rep", F.col("rep"), F.col("obs") / F.col("car")))
    weights = cut(weights.where("w > 0"))
    whole = weights.groupBy("sub").agg(F.sum("w").alias("whole"))
    given = weights.join(whole, "sub").join(nodes.select(F.col("rep").alias("sub"), "obs"), "sub")
    gain = given.groupBy(F.col("sup").alias("rep")).agg(F.sum(F.col("obs") * part * F.col("w") / F.col("whole")).alias("gain"))
    gives = nodes.join(whole.select(F.col("sub").alias("rep"), F.lit(True).alias("gives")), "rep", "left").join(gain, "rep", "left")
    return gives.select("rep", (F.when(F.col("gives"), F.col("obs") * (1 - part)).otherwise(F.col("obs")) + F.coalesce("gain", F.lit(0.0))).alias("obs"))
