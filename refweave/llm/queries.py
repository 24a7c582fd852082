"""The queries of the llm operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm import bagminhash, lowdiam, mixing, names, repetition, retrieve, survivor, tokens, unify, windows
from refweave.sources.tables import cut, drop, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = unify.field_values(table(spark, sf_dir, "refmetas"), "refid", ["a1sur", "refstring"])
    return unify.canonical_values(values).where("value <> canonical").select(F.col("key").alias("refid"), "fieldname")


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = unify.field_values(table(spark, sf_dir, "refmetas"), "refid", ["a1sur", "refstring"])
    return unify.canonical_values(values).select(F.col("key").alias("refid"), "fieldname", "canonical")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.resolved_names(table(spark, sf_dir, "refmetas"), table(spark, sf_dir, "authnames"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.survivors(*(table(spark, sf_dir, t) for t in ("refmetas", "dupmembers", "pipelines")))


def p3_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.consensus_values(*(table(spark, sf_dir, t) for t in ("refmetas", "dupmembers", "pipelines")))


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.matches(table(spark, sf_dir, "refmetas"), table(spark, sf_dir, "catrecs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_matches(spark, sf_dir).where("confidence >= 0.5").select("refid", "catid")


def _reference_texts(spark: SparkSession, sf_dir: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(refid, text) in normal form, and each text once under its smallest refid."""
    whole = unify.consistent(F.coalesce("refstring", "title"))
    rows = cut(unify.once(table(spark, sf_dir, "refmetas"), ["refid"], text=bagminhash.normal_text(whole)).where(F.length("text") >= least))
    return rows, cut(rows.groupBy("text").agg(F.min("refid").alias("id")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, texts = _reference_texts(spark, sf_dir, 3)
    members = cut(rows.join(texts, "text").select("refid", "id"))
    drop(rows)
    pairs = bagminhash.similar_pairs(texts.select("id", "text")).select("a", "b")
    x = members.select(F.col("refid").alias("x"), F.col("id").alias("a"))
    y = members.select(F.col("refid").alias("y"), F.col("id").alias("b"))
    apart = pairs.join(x, "a").join(y, "b")
    equal = x.join(y, F.col("a") == F.col("b")).where("x < y")
    return apart.select("x", "y").union(equal.select("x", "y")).select(F.least("x", "y").alias("refid_a"), F.greatest("x", "y").alias("refid_b"))


def p5_shingle_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the group of texts of at least 0.8 weighted Jaccard over five-word shingles, and its number of links."""
    rows, texts = _reference_texts(spark, sf_dir, 1)
    pairs = cut(bagminhash.similar_pairs(texts.select("id", "text"), "words", 5, 0.8, weighted=True))
    group = lowdiam.components(pairs.select("a", "b"))
    least = group.groupBy("component").agg(F.min("node").alias("groupid"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count()
    classes = texts.join(group.withColumnRenamed("node", "id"), "id", "left").join(least, "component", "left").join(links, "id", "left")
    classes = classes.select("text", F.coalesce("groupid", "id").alias("groupid"), F.coalesce("count", F.lit(0)).alias("links"))
    return rows.join(classes, "text").select("refid", "groupid", "links")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lowdiam.groups(table(spark, sf_dir, "components"), table(spark, sf_dir, "repmatches"))


def p8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.fill(tokens.with_tokens(table(spark, sf_dir, "documents")), table(spark, sf_dir, "containers"))


def p8_fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, documents and the share of room used, per kind of container."""
    filled = p8_windows(spark, sf_dir)
    each = filled.groupBy("containername", "container").agg(F.sum("tokens").alias("tokens"))
    rates = each.groupBy("containername").agg(F.count("*").alias("containers"), F.max("tokens").alias("fullest"), F.sum("tokens").alias("tokens"))
    return rates.join(table(spark, sf_dir, "containers"), "containername").withColumn("used", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4))


def p9_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.with_tokens(table(spark, sf_dir, "documents"), keep=("doc_id", "source"))
    return mixing.mixed(sizes, table(spark, sf_dir, "mixtargets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p9_mixes(spark, sf_dir), table(spark, sf_dir, "mixtargets"))


def p10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_repetition(spark, sf_dir).where("words_in_repeated_8 >= 0.3").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p1_found, p1_canonical, p2_found, p3_found, p3_consensus, p4_found, p4_matches, p5_found, p5_shingle_groups, p6_found, p8_windows, p8_fill_rates, p9_mixes, p9_shares, p10_found, p10_repetition]
    return {f.__name__: f for f in named}


SQL = {
    # Labels and unlabelled representations as nodes; every label is linked to the smallest label of each of its representations.
    "p6_found": """
        with recursive least as (select repidindex as r, min(label) as m from components where label is not null group by 1),
        reps as (select repidindex as r from components union select repidindex_a from repmatches where repidindex_a is not null union select repidindex_b from repmatches where repidindex_b is not null),
        node as (select reps.r, coalesce(m, -1 - reps.r) as n from reps left join least using (r)),
        edge as (select label as a, m as b from components join least on r = repidindex where label is not null
            union select x.n, y.n from repmatches join node x on x.r = repidindex_a join node y on y.r = repidindex_b where verdict = 1),
        link as (select a, b from edge union select b, a from edge union select n, n from node),
        walk as (select a as n, b as seen from link union select walk.n, link.b from walk join link on link.a = walk.seen),
        found as (select n, min(seen) filter (seen >= 0) as groupid from walk group by n)
        select r as repidindex, groupid from node join found using (n)
    """,
    "p10_found": """
        with w as (select doc_id, regexp_extract_all(lower(text), '\\p{L}+') as ws from documents where text is not null),
        g as (select doc_id, i, ws[i:i + 7] as gram from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w)),
        again as (select doc_id, i from g qualify i > min(i) over (partition by doc_id, gram)),
        hit as (select distinct doc_id, unnest(range(i, i + 8)) as k from again),
        n as (select doc_id, count(*) as hits from hit group by doc_id)
        select doc_id from n join w using (doc_id) where hits >= 0.3 * len(ws)
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
