"""Per-key results where a few keys hold most records (problem 7).

Rows are range partitioned on (key, item) by sampled quantiles, so that a heavy
key spreads over as many partitions as its share asks for, and sorted. One pass
over a partition gives a partial state per key: rows, distinct items, first and
last item. A key inside a partition is finished there; only the first and last
key of each partition, at most two states a partition, meet again and are
stitched in the order of the partitions.

Defined cases: a null key is dropped; a null item counts as a row, not as a
distinct item; an empty table gives no key; repeated rows count as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refweave.sources.tables import cut, parallelism


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    names = ["key", "rows", "items", "first_item", "last_item", "part", "edge"]
    schema = None
    held: list | None = None  # the state of the key that may go on in the next batch
    head = True  # whether no key of this partition has been given out

    def give(states: list[list], edge: bool) -> pa.RecordBatch:
        cols = list(zip(*states, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip([*cols, [part] * len(states), [edge] * len(states)], schema, strict=True)], schema=schema)

    for batch in batches:
        key, item = batch.column(0), batch.column(1)
        n = len(key)
        if not n:
            continue
        if schema is None:
            schema = pa.schema([("key", key.type), ("rows", pa.int64()), ("items", pa.int64()), ("first_item", item.type), ("last_item", item.type), ("part", pa.int32()), ("edge", pa.bool_())])
        new_key = np.ones(n, bool)
        new_item = np.ones(n, bool)
        if n > 1:
            new_key[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            differs = pc.fill_null(pc.not_equal(item[1:], item[:-1]), True)
            new_item[1:] = new_key[1:] | differs.to_numpy(zero_copy_only=False)
        new_item &= pc.is_valid(item).to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(new_key)
        end = np.concatenate((begin[1:], [n]))
        counts = np.add.reduceat(new_item.astype(np.int64), begin)
        states = [list(x) for x in zip(key.take(pa.array(begin)).to_pylist(), (end - begin).tolist(), counts.tolist(), item.take(pa.array(begin)).to_pylist(), item.take(pa.array(end - 1)).to_pylist(), strict=True)]
        if held is not None and held[0] == states[0][0]:
            first = states[0]
            same = first[3] is not None and first[3] == held[4]
            states[0] = [held[0], held[1] + first[1], held[2] + first[2] - same, held[3] if held[3] is not None else first[3], first[4]]
        elif held is not None:
            states.insert(0, held)
        held = states.pop()
        if states and head:
            yield give(states[:1], True)
            states, head = states[1:], False
        if states:
            yield give(states, False)
    if held is not None:
        yield give([held], True)
    assert schema is None or schema.names == names


def key_counts(df: DataFrame, key: Column, item: Column, partitions: int | None = None) -> DataFrame:
    """(key, rows, items): rows and distinct items of every key."""
    pairs = df.select(key.alias("key"), item.alias("item")).where("key is not null")
    k, i = (pairs.schema[c].dataType.simpleString() for c in ("key", "item"))
    ranged = pairs.repartitionByRange(partitions or parallelism(df), "key", "item").sortWithinPartitions("key", "item")
    # A table, as two branches read it: sampled again, the range bounds of one could differ from those of the other.
    states = cut(ranged.mapInArrow(_runs, f"key {k}, rows long, items long, first_item {i}, last_item {i}, part int, edge boolean"))
    by_part = Window.partitionBy("key").orderBy("part")
    meets = F.coalesce(F.lag("last_item").over(by_part) == F.col("first_item"), F.lit(False)).cast("long")
    # An inner key is whole: the partial sums below combine before the exchange and meet no other state of that key.
    edges = states.where("edge").withColumn("items", F.col("items") - meets)
    return states.where("not edge").select("key", "rows", "items").union(edges.groupBy("key").agg(F.sum("rows").alias("rows"), F.sum("items").alias("items")))


def heavy_keys(df: DataFrame, key: Column, item: Column, share: float, total: DataFrame | None = None) -> DataFrame:
    """Keys with at least ``share`` of all distinct items: (key, items).

    total: one row with the column ``total``; by default the distinct items of
    all rows that have a key, counted by the same operator under one key.
    """
    keyed = df.where(key.isNotNull())
    if total is None:
        total = key_counts(keyed, F.lit(0), item).select(F.col("items").alias("total"))
    return key_counts(keyed, key, item).join(F.broadcast(total.limit(1)), F.col("items") >= share * F.col("total")).select("key", "items")
