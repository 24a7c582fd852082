"""Connected components and partial orders over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.sources.tables import cut, drop


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for edges (a, b): component is the smallest node of the group.

    Alternating star contraction: every node of a star of larger neighbours is
    linked to the smallest node around, then every node keeps only its link to
    the smallest; rounds grow with the logarithm of the longest chain. Nulls
    drop an edge; loops are nodes on their own.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = cut(small)
        facts = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(links)
        links = after
        if facts == before:
            break
        before = facts
    else:
        raise ValueError("the components are not settled after max_rounds")
    return nodes.join(links.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def contained(features: DataFrame) -> DataFrame:
    """(sub, sup): sets of (rep, f) properly contained in others, by size.

    Every set is looked up under its rarest feature only; a superset must have
    it, and the whole set is then compared within the pair.
    """
    features = cut(features.select("rep", "f").distinct())
    df = features.groupBy("f").agg(F.count("*").alias("df"))
    sets = cut(features.join(df, "f").groupBy("rep").agg(F.sort_array(F.collect_list("f")).alias("fs"), F.count("*").alias("size"), F.min(F.struct("df", "f")).alias("rarest")))
    sub = sets.select(F.col("rep").alias("sub"), F.col("fs").alias("own"), F.col("size").alias("small"), F.col("rarest.f").alias("f"))
    sup = sets.select(F.col("rep").alias("sup"), F.col("fs").alias("whole"), F.col("size").alias("large"), F.explode("fs").alias("f"))
    met = sub.join(sup, "f").where("small < large")
    return met.where(F.size(F.array_except("own", "whole")) == 0).select("sub", "sup", "small", "large")


def minimal(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rep): sets that contain no other."""
    return features.select("rep").distinct().join(pairs.select(F.col("sup").alias("rep")), "rep", "left_anti")


def poset_blocks(features: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(rep, block): components of minimal elements and their supersets; a set apart is its own block."""
    pairs = cut(contained(features)) if pairs is None else pairs
    least = minimal(features, pairs)
    edges = pairs.join(least.withColumnRenamed("rep", "sub"), "sub", "left_semi").select(F.col("sub").alias("a"), F.col("sup").alias("b"))
    alone = features.select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct()
    return components(edges.union(alone)).select(F.col("node").alias("rep"), F.col("component").alias("block"))


def hasse(pairs: DataFrame) -> DataFrame:
    """(sub, sup): pairs of the order with nothing between them."""
    longer = pairs.alias("x").join(pairs.alias("y"), F.col("x.sup") == F.col("y.sub")).select(F.col("x.sub").alias("sub"), F.col("y.sup").alias("sup")).distinct()
    return pairs.select("sub", "sup").join(longer, ["sub", "sup"], "left_anti")


def levels(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, level): longest path from a minimal node of an acyclic graph (sub, sup)."""
    nodes = edges.select(F.explode(F.array("sub", "sup")).alias("node")).distinct()
    now = cut(nodes.withColumn("level", F.lit(0)))
    for _ in range(max_rounds):
        up = edges.join(now.withColumnRenamed("node", "sub"), "sub").groupBy(F.col("sup").alias("node")).agg((F.max("level") + 1).alias("up"))
        after = cut(now.join(up, "node", "left").select("node", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level")))
        if not after.join(now.withColumnRenamed("level", "old"), "node").where("level <> old").limit(1).count():
            return after
        now = after
    raise ValueError("the graph has a cycle or a longer path than max_rounds")


def closure(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(sub, sup): all pairs joined by a path, by doubling."""
    now = cut(edges.select("sub", "sup").distinct())
    for _ in range(max_rounds):
        longer = now.alias("x").join(now.alias("y"), F.col("x.sup") == F.col("y.sub")).select(F.col("x.sub").alias("sub"), F.col("y.sup").alias("sup"))
        after = cut(now.union(longer).distinct())
        if after.count() == now.count():
            return after
        now = after
    raise ValueError("the closure is not settled after max_rounds")


def reduction(edges: DataFrame) -> DataFrame:
    """(sub, sup): the edges of an acyclic graph that no longer path replaces."""
    whole = closure(edges)
    longer = edges.alias("x").join(whole.alias("y"), F.col("x.sup") == F.col("y.sub")).select(F.col("x.sub").alias("sub"), F.col("y.sup").alias("sup")).distinct()
    return edges.select("sub", "sup").distinct().join(longer, ["sub", "sup"], "left_anti")


def observed_and_carried(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rep, obs, car): own count, and own count plus that of all sets that contain this one."""
    over = pairs.join(counts.select(F.col("rep").alias("sup"), "obs"), "sup").groupBy(F.col("sub").alias("rep")).agg(F.sum("obs").alias("over"))
    return counts.join(over, "rep", "left").select("rep", "obs", (F.col("obs") + F.coalesce("over", F.lit(0))).alias("car"))


def heaviest_parent(edges: DataFrame) -> DataFrame:
    """(child, parent, weight): for every child the parent of the largest weight, the smaller id on a tie."""
    return edges.groupBy("child").agg(F.max_by(F.struct("parent", "weight"), F.struct("weight", (-F.col("parent")).alias("p"))).alias("best")).select("child", "best.parent", "best.weight")
