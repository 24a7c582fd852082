"""Queries of the operator for heavy keys (problem 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.operators.skew import heavy_keys, key_counts
from refweave.sources.tables import table

SHARE = 0.01


def _repid() -> Column:
    return F.nullif(F.lower(F.trim("repid")), F.lit(""))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = heavy_keys(table(spark, sf_dir, "mentions"), _repid(), F.col("mentionid"), SHARE)
    components = table(spark, sf_dir, "components")
    # All representations count in the total, those whose label is null too.
    total = key_counts(components, F.lit(0), F.col("repidindex")).select(F.col("items").alias("total"))
    labels = heavy_keys(components, F.col("label"), F.col("repidindex"), SHARE, total)
    named = lambda df, name: df.select(F.lit(name).alias("fieldname"), F.col("key").cast("string").alias("keyval"))
    return named(mentions, "mentions.repid").union(named(labels, "components.label"))


def p7_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct mentions of every repid."""
    return key_counts(table(spark, sf_dir, "mentions"), _repid(), F.col("mentionid")).select(F.col("key").alias("repid"), F.col("rows").alias("n_rows"), F.col("items").alias("n_mentions"))


QUERIES = {"p7_found": p7_found, "p7_key_counts": p7_key_counts}

_CLEAN = "nullif(lower(trim(repid, ' ')), '')"
SQL = {
    "p7_found": f"""
        with m as (select {_CLEAN} as k, mentionid from mentions where {_CLEAN} is not null),
        c as (select label, repidindex from components)
        select 'mentions.repid' as fieldname, k as keyval from m group by k
        having count(distinct mentionid) >= {SHARE} * (select count(distinct mentionid) from m)
        union all
        select 'components.label', cast(label as varchar) from c where label is not null group by label
        having count(distinct repidindex) >= {SHARE} * (select count(distinct repidindex) from c)
    """,
    "p7_key_counts": f"""
        select {_CLEAN} as repid, count(*) as n_rows, count(distinct mentionid) as n_mentions
        from mentions where {_CLEAN} is not null group by 1
    """,
}
