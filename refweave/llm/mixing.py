"""Mixing sources to target weights (problem 9): systematic sampling.

Within a source every document is expected equally often: copies = weight *
total / tokens of the source. Documents are ranked by size within their source
by a range partition and the counts of its partitions, the expected copies are
prefix-summed along that order, one random offset per mix and source is added,
and a document comes out once per integer boundary crossed. As neighbours in
the order are of like size, the tokens reached follow the weights closely; what
is left to chance is whether the few largest documents are hit, so that of
OFFSETS random offsets the one whose tokens come nearest to the target is taken.
No document can exceed the ceiling of its expected copies.

total: the corpus' tokens, or less where some source can't fill its weight with
maxrepeats copies of each document; weights are then still met.

Defined cases: sources are compared trimmed and in lower case, null sources and
sources without a target are in no mix; a source without tokens is left out and
the rest keeps its weights' proportions; empty texts have no share to give and
are chosen like others; repeated rows are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refweave.sources.tables import cut, drop, parallelism


OFFSETS = 24


def ranked(sizes: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds ``rank``, from 0, along the order within ``by``, however many rows one value holds."""
    ranged = cut(sizes.repartitionByRange(parallelism(sizes), by, *order).withColumn("piece", F.spark_partition_id()))
    drop(sizes)
    pieces = ranged.groupBy(by, "piece").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = pieces.select(by, "piece", before.alias("before"))
    within = F.row_number().over(Window.partitionBy(by, "piece").orderBy(*order)) - 1
    return ranged.withColumn("within", within).join(offsets, [by, "piece"]).withColumn("rank", F.col("within") + F.col("before")).drop("within", "before", "piece")


def mixed(sizes: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """(mixname, source, doc_id, tokens, copies) for (doc_id, source, tokens) and (mixname, source, weight, maxrepeats)."""
    # A table, as the ranges are sampled from it: the sizes aren't counted again.
    own = cut(sizes.select("doc_id", F.lower(F.trim("source")).alias("source"), "tokens").where("source is not null"))
    wanted = targets.select("mixname", F.lower(F.trim("source")).alias("source"), "weight", "maxrepeats").where("weight > 0")
    order = cut(ranked(own, "source", ["tokens", "doc_id"]))
    have = order.groupBy("source").agg(F.sum("tokens").alias("have")).where("have > 0")
    plan = wanted.join(have, "source")
    mix = Window.partitionBy("mixname")
    plan = plan.withColumn("weight", F.col("weight") / F.sum("weight").over(mix))
    plan = plan.withColumn("total", F.least(F.sum("have").over(mix), F.min(F.col("maxrepeats") * F.col("have") / F.col("weight")).over(mix)))
    plan = plan.withColumn("rate", F.least(F.col("weight") * F.col("total") / F.col("have"), F.col("maxrepeats").cast("double")))
    met = order.join(plan, "source")
    offset = lambda k: F.pmod(F.xxhash64("mixname", "source", F.lit(seed), F.lit(k)), F.lit(1_000_003)) / 1_000_003
    copies = lambda at: F.floor((F.col("rank") + 1) * F.col("rate") + at) - F.floor(F.col("rank") * F.col("rate") + at)
    reached = met.groupBy("mixname", "source").agg(F.first(F.col("weight") * F.col("total")).alias("target"), *[F.sum(F.col("tokens") * copies(offset(k))).alias(f"t{k}") for k in range(OFFSETS)])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), offset(k).alias("offset")) for k in range(OFFSETS)]))["offset"]
    # One row per mix and source.
    chosen = cut(reached.select("mixname", "source", nearest.alias("offset")))
    both = met.join(chosen, ["mixname", "source"]).withColumn("copies", copies(F.col("offset")).cast("long"))
    return both.select("mixname", "source", "doc_id", "tokens", "copies").where("copies > 0")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(mixname, source, weight, documents, copies, most, tokens, share): what every mix reached."""
    got = chosen.groupBy("mixname", "source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    wanted = targets.select("mixname", F.lower(F.trim("source")).alias("source"), "weight", "maxrepeats")
    full = wanted.join(got, ["mixname", "source"], "left").na.fill(0, ["documents", "copies", "most", "tokens"])
    return full.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("mixname")))
