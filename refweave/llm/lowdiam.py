"""Consolidating pairwise matches into groups (problem 6).

Low-diameter decomposition: every node draws an exponential head start, all
nodes grow clusters at one hop a round, and a node belongs to the cluster that
reaches it first. The clusters become super-vertices, the edges between them
the next graph, and so on until no edge is left; the assignments of all levels
are composed.

Head starts end at MOST hops, so that as many hops end a level and no round asks
whether another is due. A hop is one join of the edges, partitioned by node once
a level, with the nodes reached anew, and one aggregation with partial minima
before its exchange. What is left of the graph once FINISH edges or fewer remain
after a level, a counted bound, is decomposed and contracted to its end by the
same steps on arrays in one task; any larger graph stays distributed.

Defined cases: null ends drop an edge, loops and repeated edges change nothing,
a node without edges is its own group, an empty table gives an empty result.
The result doesn't depend on the head starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.llm.bagminhash import mix
from refweave.sources.tables import cut, drop

BETA, MOST, FINISH = 0.3, 6, 100_000


def _decomposed(edges: DataFrame, seed: int) -> DataFrame:
    """(node, center) for symmetric edges (a, b): the cluster that reaches each node first."""
    uniform = (F.shiftrightunsigned(F.xxhash64("node", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(2.0**53)
    start = F.struct(F.greatest(F.log(uniform) / BETA, F.lit(-float(MOST))).alias("at"), F.col("node").alias("center"))
    by_end = edges.select("a", F.col("b").alias("node")).repartition("node")
    now = by_end.select("node").distinct().select("node", start.alias("reach"), F.lit(True).alias("fresh"))
    for _ in range(MOST):
        told = by_end.join(now.where("fresh"), "node").select(F.col("a").alias("node"), F.struct((F.col("reach.at") + 1).alias("at"), F.col("reach.center").alias("center")).alias("reach"), F.lit(None).cast(now.schema["reach"].dataType).alias("before"))
        met = now.select("node", "reach", F.col("reach").alias("before")).unionByName(told).groupBy("node").agg(F.min("reach").alias("reach"), F.max("before").alias("before"))
        now = met.select("node", "reach", (F.col("reach") < F.col("before")).alias("fresh"))
    return now.select("node", F.col("reach.center").alias("center"))


def _decomposed_arrays(a: np.ndarray, b: np.ndarray, nodes: int, seed: int) -> np.ndarray:
    """The center of each node of symmetric edges between the nodes 0 .. nodes - 1, by the same rule."""
    uniform = ((mix(np.arange(nodes, dtype=np.uint64) ^ mix(np.full(nodes, seed, np.uint64))) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    at, center = np.maximum(np.log(uniform) / BETA, -float(MOST)), np.arange(nodes)
    for _ in range(MOST):
        order = np.lexsort((center[b], at[b], a))
        first = order[np.flatnonzero(np.concatenate(([True], a[order][1:] != a[order][:-1])))]
        node, arrival, of = a[first], at[b[first]] + 1, center[b[first]]
        sooner = arrival < at[node]
        at[node[sooner]], center[node[sooner]] = arrival[sooner], of[sooner]
    return center


def _finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, center) of a bounded graph, decomposed and contracted until no edge is left."""
    parts = [p for p in batches if len(p)]
    if not parts:
        return
    ends = pd.concat(parts)[["a", "b"]].to_numpy(np.int64)
    names, ids = np.unique(ends, return_inverse=True)
    a, b = ids.reshape(ends.shape).T
    group, level = np.arange(len(names)), 0
    while len(a):
        center = _decomposed_arrays(a, b, len(names), level)
        group = center[group]
        a, b = center[a], center[b]
        key = np.unique((a * len(names) + b)[a != b])
        a, b = key // len(names), key % len(names)
        level += 1
    yield pd.DataFrame({"node": names, "center": names[group]})


def components(edges: DataFrame, seed: int = 17, finish: int = FINISH) -> DataFrame:
    """(node, component) for every end of the edges (a, b): component is one node of the group."""
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    first = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    lone = first.where("a = b").select(F.col("a").alias("node"))
    graph = first.where("a <> b")
    graph = cut(graph.union(graph.select("b", "a")))
    left, levels = graph.count(), []
    while left:
        done, level = bool(levels) and left <= 2 * finish, len(levels)
        levels.append(cut(graph.repartition(1).mapInPandas(_finished, "node long, center long") if done else _decomposed(graph, seed + level)))
        if done:
            break
        to = lambda end, name: levels[-1].select(F.col("node").alias(end), F.col("center").alias(name))
        # Each edge once, as the smaller of its directions, then both ways again.
        ends = graph.where("a < b").join(to("a", "x"), "a").join(to("b", "y"), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        now = cut(ends.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*"))
        drop(graph)
        graph, left = now, now.count()
    members = None
    for own in reversed(levels):
        known = own if members is None else own.join(members.select(F.col("node").alias("center"), F.col("center").alias("top")), "center", "left").select("node", F.coalesce("top", "center").alias("center"))
        members = known
    alone = lone.select("node", F.col("node").alias("component"))
    if members is None:
        return alone
    members = cut(members.select("node", F.col("center").alias("component")))
    whole = members.union(alone.join(members.select("node"), "node", "left_anti"))
    drop(graph, *levels)
    return whole


def groups(labels: DataFrame, matches: DataFrame, finish: int = FINISH) -> DataFrame:
    """(repidindex, groupid): the smallest label found in the group of each representation.

    labels (label, repidindex), matches (repidindex_a, repidindex_b, verdict).
    The star of a label is contracted beforehand: a representation stands at the
    smallest of its labels, which is linked to its others, so that no label of
    any size is a hub of the graph; one without label stands for itself. A group
    without any label has groupid null.
    """
    named = labels.where("repidindex is not null").select(F.col("repidindex").cast("long").alias("r"), F.col("label").cast("long").alias("label"))
    sides = matches.select(F.col("repidindex_a").cast("long").alias("ra"), F.col("repidindex_b").cast("long").alias("rb"), "verdict")
    seen = sides.select(F.explode(F.array("ra", "rb")).alias("r"), F.lit(None).cast("long").alias("label")).where("r is not null")
    # Labels are odd nodes, representations without one even nodes.
    reps = cut(named.unionByName(seen).groupBy("r").agg(F.min("label").alias("least")).withColumn("node", F.coalesce(F.col("least") * 2 + 1, F.col("r") * 2)))
    spread = named.where("label is not null").join(reps.select("r", "node"), "r").select((F.col("label") * 2 + 1).alias("a"), F.col("node").alias("b"))
    at = lambda end, name: reps.select(F.col("r").alias(end), F.col("node").alias(name))
    linked = sides.where("verdict = 1 and ra is not null and rb is not null").join(at("ra", "a"), "ra").join(at("rb", "b"), "rb").select("a", "b")
    found = components(spread.union(linked).where("a <> b"), finish=finish)
    least = found.where("node % 2 <> 0").groupBy("component").agg(F.min(F.expr("(node - 1) div 2")).alias("groupid"))
    placed = found.join(least, "component").select("node", "groupid")
    return reps.join(placed, "node", "left").select(F.col("r").alias("repidindex"), F.coalesce("groupid", "least").alias("groupid"))
