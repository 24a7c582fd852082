"""Numbering, first-wins and set operators that hold at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refweave.sources.tables import cut, parallelism


def dense_numbers(df: DataFrame, by: str, name: str) -> DataFrame:
    """Numbers 1, 2, ... in the order of a column of distinct values, without one task seeing all of them."""
    ranged = cut(df.repartitionByRange(parallelism(df), by).withColumn("_piece", F.spark_partition_id()))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("_piece").count().select("_piece", before.alias("_before"))  # one row per partition
    within = F.row_number().over(Window.partitionBy("_piece").orderBy(by))
    return ranged.withColumn("_within", within).join(offsets, "_piece").withColumn(name, F.col("_within") + F.col("_before")).drop("_piece", "_within", "_before")


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the order; combined before the exchange, so that a heavy key is no single task's."""
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_row"))).alias("_first"))
    return first.select(*key, "_first._row.*").select(*df.columns)


def except_then_intersect(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """(a except b) intersect c, from left to right."""
    return a.subtract(b).intersect(c)
