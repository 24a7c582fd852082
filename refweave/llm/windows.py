"""Filling fixed-capacity containers with items (problem 8).

Documents are dealt by a hash of their id into blocks of about WINDOWS
containers' worth of tokens. Within a block Karmarkar-Karp differencing merges
the two partial partitions of the largest imbalance, the fullest window of one
with the emptiest of the other, until one partition of near-equal windows is
left; while its fullest window exceeds the capacity, the window count rises. A
document longer than the capacity gives whole containers and one rest.

Defined cases: null and empty texts take no room but get a container like any
other; a document of exactly the capacity fills one container; equal sizes keep
the order of ids; an empty table, or one without a container of positive
capacity, gives no row.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.sources.tables import cut

WINDOWS, BLOCK_ITEMS = 64, 20_000


def differenced(sizes: list[int], windows: int) -> list[list[int]]:
    """Item numbers of each window of the largest-differencing partition."""
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(sizes)
    base = [[] for _ in range(windows)]
    if not heap:
        return base
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        # Windows of zero aren't kept: both lists are descending, and the k-th fullest meets the k-th emptiest.
        overlap = len(a) + len(b) - windows
        if overlap <= 0:
            merged = a + b
            low = 0
        else:
            merged = a[: len(a) - overlap] + b[: len(b) - overlap]
            merged += [(a[len(a) - overlap + k][0] + b[len(b) - 1 - k][0], a[len(a) - overlap + k][1] + b[len(b) - 1 - k][1]) for k in range(overlap)]
            low = min(x[0] for x in merged)
        merged.sort(key=lambda x: -x[0])
        if low:
            merged = [(s - low, items) for s, items in merged]
        spread = merged[0][0] if len(merged) < windows else merged[0][0] - merged[-1][0]
        heapq.heappush(heap, (-spread, order, merged))
        order += 1
    out = [items for _, items in heap[0][2]]
    return out + base[len(out) :]


def packed(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows none of which exceeds the capacity; no size may exceed it.

    The window count rises in growing steps until none is exceeded, and the last step is then halved down to the least
    count that holds.
    """
    fits = lambda parts: all(sum(sizes[i] for i in p) <= capacity for p in parts)
    low = max(1, -(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes)) - 1
    step, windows = 1, low + 1
    while not fits(best := differenced(sizes, windows)):
        low, step = windows, 2 * step
        windows += step
    while windows - low > 1:
        middle = (low + windows) // 2
        if fits(parts := differenced(sizes, middle)):
            windows, best = middle, parts
        else:
            low = middle
    return [p for p in best if p]


def _block(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")
    capacity, block = int(group["capacity"].iloc[0]), int(group["block"].iloc[0])
    rows, rest = [], []
    number = 0
    for doc, tokens in zip(group["doc_id"], group["tokens"], strict=True):
        whole = tokens // capacity
        for part in range(whole):
            rows.append((number, doc, part, part * capacity, capacity))
            number += 1
        if tokens % capacity or not tokens:
            rest.append((doc, whole, whole * capacity, tokens % capacity))
    for window in packed([r[3] for r in rest], capacity) if rest else []:
        rows += [(number, *rest[i]) for i in window]
        number += 1
    out = pd.DataFrame(rows, columns=["container", "doc_id", "part", "start", "tokens"])
    out["container"] += block << 32
    return out.assign(containername=group["containername"].iloc[0])


def fill(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """(containername, container, doc_id, part, start, tokens) for (doc_id, tokens) and (containername, capacity)."""
    sizes = cut(sizes)
    total = sizes.agg(F.sum("tokens").alias("total"), F.count("*").alias("docs"))
    blocks = F.greatest(F.ceil(F.col("total") / (F.col("capacity") * WINDOWS)), F.ceil(F.col("docs") / BLOCK_ITEMS), F.lit(1))
    plan = containers.where("capacity > 0").crossJoin(total).select("containername", "capacity", blocks.alias("blocks"))
    kinds = plan.collect()  # one row per kind of container
    if not kinds:
        return sizes.sparkSession.createDataFrame([], "containername string, container long, doc_id long, part long, start long, tokens long")
    per_kind = F.explode(F.array(*[F.struct(F.lit(r.containername).alias("containername"), F.lit(r.capacity).cast("long").alias("capacity"), F.lit(r.blocks).cast("long").alias("blocks")) for r in kinds]))
    items = sizes.select("doc_id", "tokens", per_kind.alias("c")).select("doc_id", "tokens", "c.containername", "c.capacity", F.expr("pmod(xxhash64(doc_id), c.blocks)").alias("block"))
    return items.groupBy("containername", "block").applyInPandas(_block, "container long, doc_id long, part long, start long, tokens long, containername string").select("containername", "container", "doc_id", "part", "start", "tokens")
