"""Queries of the reshaping, pair-count and set operators that the other modules leave."""

from __future__ import annotations


from pyspark.sql import functions as F

from refweave.operators import evaluate as E
from refweave.operators import graph as G
from refweave.plans.linkage import _REPF, _features, _grouped, _rep, _rep_features, _sql_features
from refweave.plans.scalars import TARGETS
from refweave.sources import files as S
from refweave.sources.tables import cut, table


ARRAYS = ("scan", "layout", "plain")


def prj1_flatten(spark, sf_dir):
    """Documents with an array of references per kind of extraction, flattened again with the kind and the place of each."""
    refs = table(spark, sf_dir, "refmetas").select("refid", "title", F.regexp_extract("linkid", "_(doc[0-9]+)_ref_", 1).alias("doc"), F.regexp_extract("linkid", "_from_(scan|layout|plain)_", 1).alias("kind")).where("doc <> '' and kind <> ''")
    own = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("refid", "title")))).alias(k)
    docs = refs.groupBy("doc").agg(*[own(k) for k in ARRAYS])
    return S.flatten_documents(docs, list(ARRAYS), "doc").select("doc", "pipeline", "list_index", "ref.refid", "ref.title")


def prj4_restore_originals(spark, sf_dir):
    """Where a row was delivered again, its first title; a null there stays."""
    r = table(spark, sf_dir, "refmetas").select("refid", "linkid", "title", "loaded_at")
    first = r.groupBy("linkid").agg(F.min_by(F.struct("title"), F.struct("loaded_at", "refid")).alias("f"))
    return r.join(first, "linkid").select("refid", F.col("f.title").alias("title"))


def prj6_pairs(spark, sf_dir):
    """Every filled field as (row, field, value)."""
    names = ["title", "source", "year", "volume", "issue", "a1sur", "publisher1"]
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in names]))
    return table(spark, sf_dir, "refmetas").select("refid", long.alias("p")).select("refid", "p.*").where("value is not null")


def prj7_mapping(spark, sf_dir):
    """Fields under other names, empty ones dropped."""
    return table(spark, sf_dir, "refmetas").select("refid", F.nullif("title", F.lit("")).alias("name"), F.nullif("source", F.lit("")).alias("container"), F.nullif("year", F.lit(0)).alias("issued"))


def prj10_underspecified(spark, sf_dir):
    """Rows that fail a rule of required columns, with the number of the first rule they fail."""
    rules = [["a1sur", "e1sur", "publisher1"], ["title", "refstring"], ["year"]]
    failed = F.coalesce(*[F.when(S.underspecified(*r), F.lit(i)) for i, r in enumerate(rules)])
    return table(spark, sf_dir, "refmetas").select("refid", failed.alias("rule")).where("rule is not null")


def jn5_pair_counts(spark, sf_dir):
    """Pairs of different mentions with equal label, from the sizes of labels."""
    m = table(spark, sf_dir, "mentions").where("label is not null").select("mentionid", "label").distinct()
    n = m.groupBy("label").agg(F.count("*").alias("n"))
    return n.agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))


def jn6_size_matches(spark, sf_dir):
    """Representations per label against mentions per label: equal, fewer, more."""
    m = table(spark, sf_dir, "mentions").where("label is not null").groupBy("label").agg(F.countDistinct("mentionid").alias("mentions"))
    c = table(spark, sf_dir, "components").where("label is not null").groupBy("label").agg(F.countDistinct("repidindex").alias("reps"))
    side = F.when(F.col("mentions") == F.col("reps"), "equal").when(F.col("mentions") < F.col("reps"), "fewer").otherwise("more")
    return m.join(c, "label").groupBy(side.alias("relation")).agg(F.count("*").alias("labels"))


def jn8_shared_features(spark, sf_dir):
    """Features two rows of a block share, by type."""
    from refweave.operators.similarity import shared_features

    return shared_features(cut(_features(_grouped(spark, sf_dir)))).select("a", "b", "ftype", "shared")


def st2_except(spark, sf_dir):
    m = table(spark, sf_dir, "mentions")
    return table(spark, sf_dir, "components").select("label").subtract(m.where("runno = 1").select("label")).subtract(m.where("runno = 2").select("label"))


def ag11_labels_of_representation(spark, sf_dir):
    """The labels of every representation as one text, sorted as text."""
    c = table(spark, sf_dir, "components").where("label is not null and repidindex is not null")
    return c.groupBy("repidindex").agg(F.array_join(F.array_sort(F.collect_set(F.col("label").cast("string"))), ",").alias("labels"))


def ag12_minimal_recall(spark, sf_dir):
    """Pairs of sets that some minimal set lies under, of all pairs of a block: sums by block size."""
    features = cut(_rep_features(spark, sf_dir))
    pairs = cut(G.contained(features))
    least = G.minimal(features, pairs).withColumnRenamed("rep", "sub")
    per = pairs.join(least, "sub").groupBy("sub").agg((F.count("*") + 1).alias("n"))
    return per.groupBy("n").agg(F.count("*").alias("minels"), F.sum(F.col("n") * F.col("n")).alias("pairs"))


def ag12_gold_recall(spark, sf_dir):
    """Recall and precision of blocking by minimal sets against the mentions' gold ids, weighted by frequency.

    A mention has the set of its reference, as first delivered; one without gold id, reference or features takes no part.
    """
    features = cut(_rep_features(spark, sf_dir))
    pairs = cut(G.contained(features))
    least = cut(G.minimal(features, pairs))
    under = pairs.join(least.withColumnRenamed("rep", "sub"), "sub").select(F.col("sup").alias("rep"), F.col("sub").alias("minel")).union(least.select("rep", F.col("rep").alias("minel")))
    first = table(spark, sf_dir, "refmetas").groupBy(F.col("linkid").alias("originalid")).agg(F.min_by(F.struct(_rep().alias("rep")), F.struct("loaded_at", "refid")).alias("f"))
    mentions = table(spark, sf_dir, "mentions").select("mentionid", "originalid", F.col("goldid").alias("gold"), "freq").distinct()
    return E.minimal_recall(mentions.join(first, "originalid").select("gold", "f.rep", "freq"), under)


def ag21_signatures(spark, sf_dir):
    """Signatures of filled fields: distinct combinations of values (types) and rows (tokens) of each."""
    names = ["title", "year", "a1sur", "source"]
    sig = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names])), "+")
    return table(spark, sf_dir, "refmetas").groupBy(sig.alias("signature")).agg(F.count("*").alias("tokens"), F.countDistinct(F.struct(*names)).alias("types"))


def gr12_minimal_supersets(spark, sf_dir):
    """Every minimal set with the sets that contain it."""
    features = cut(_rep_features(spark, sf_dir))
    pairs = cut(G.contained(features))
    return pairs.join(G.minimal(features, pairs).withColumnRenamed("rep", "sub"), "sub").select(F.col("sub").alias("minel"), F.col("sup").alias("superset"))


def snk10_copy_column(spark, sf_dir):
    """A cluster id put under the duplicate id's name where there is one."""
    return table(spark, sf_dir, "mentions").select("mentionid", F.when(F.col("label").isNotNull(), F.col("label").cast("string")).alias("duplicate_id2")).distinct()


def snk10_conditional_copy(spark, sf_dir):
    """The target id in the place of the link id wherever there is one."""
    return table(spark, sf_dir, "refmetas").select("refid", F.when(F.col("crossrefid").isNotNull(), F.col("crossrefid")).otherwise(F.col("linkid")).alias("linkid"))


def src4_page(spark, sf_dir):
    """The third page of five hundred representations in the order of their labels: paging is what is asked for."""
    c = table(spark, sf_dir, "components").where("label is not null").select("label", "repidindex").distinct()
    return c.orderBy("label", "repidindex").offset(1000).limit(500)


def prj5_target_counts(spark, sf_dir):
    """Rows with each target id and its distinct values."""
    long = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("value")) for t in TARGETS]))
    return table(spark, sf_dir, "refmetas").select(long.alias("p")).where("p.value is not null").groupBy("p.target").agg(F.count("*").alias("n"), F.countDistinct("p.value").alias("ids"))


QUERIES: dict = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}
_LONG = " union all ".join(f"select refid, '{c}' as field, cast({c} as varchar) as value from refmetas where {c} is not null" for c in ("title", "source", "year", "volume", "issue", "a1sur", "publisher1"))
_SIG = "array_to_string([x for x in [case when title is not null then 'title' end, case when year is not null then 'year' end, case when a1sur is not null then 'a1sur' end, case when source is not null then 'source' end] if x is not null], '+')"

SQL = {
    "prj1_flatten": "with r as (select refid, title, regexp_extract(linkid, '_(doc[0-9]+)_ref_', 1) as doc, regexp_extract(linkid, '_from_(scan|layout|plain)_', 1) as pipeline from refmetas) select doc, pipeline, row_number() over (partition by doc, pipeline order by refid) - 1 as list_index, refid, title from r where doc <> '' and pipeline <> ''",
    "prj4_restore_originals": "select refid, first_value(title) over (partition by linkid order by loaded_at, refid) as title from refmetas",
    "prj6_pairs": _LONG,
    "prj7_mapping": "select refid, nullif(title, '') as name, nullif(source, '') as container, nullif(year, 0) as issued from refmetas",
    "prj10_underspecified": "select * from (select refid, case when coalesce(a1sur, e1sur, publisher1) is null then 0 when coalesce(title, refstring) is null then 1 when year is null then 2 end as rule from refmetas) where rule is not null",
    "jn5_pair_counts": "select sum(n * (n - 1)) as pairs from (select count(distinct mentionid) as n from mentions where label is not null group by label)",
    "jn6_size_matches": "with m as (select label, count(distinct mentionid) as a from mentions where label is not null group by label), c as (select label, count(distinct repidindex) as b from components where label is not null group by label) select case when a = b then 'equal' when a < b then 'fewer' else 'more' end as relation, count(*) as labels from m join c using (label) group by 1",
    "jn8_shared_features": f"with {_sql_features()} select a, b, ftype, i as shared from i",
    "st2_except": "select label from components except select label from mentions where runno = 1 except select label from mentions where runno = 2",
    "ag11_labels_of_representation": "select repidindex, string_agg(l, ',' order by l) as labels from (select distinct repidindex, cast(label as varchar) as l from components where label is not null and repidindex is not null) group by repidindex",
    "ag12_minimal_recall": f"with {_REPF}, per as (select sub, count(*) + 1 as n from cont where sub not in (select sup from cont) group by sub) select n, count(*) as minels, sum(n * n) as pairs from per group by n",
    "ag21_signatures": f"select {_SIG} as signature, count(*) as tokens, count(distinct {{'t': title, 'y': year, 'a': a1sur, 's': source}}) as types from refmetas group by 1",
    "gr12_minimal_supersets": f"with {_REPF} select sub as minel, sup as superset from cont where sub not in (select sup from cont)",
    "snk10_conditional_copy": "select refid, coalesce(crossrefid, linkid) as linkid from refmetas",
    "src4_page": "select distinct label, repidindex from components where label is not null order by label, repidindex limit 500 offset 1000",
    "snk10_copy_column": "select distinct mentionid, cast(label as varchar) as duplicate_id2 from mentions",
    "prj5_target_counts": " union all ".join(f"select '{t}' as target, count(*) as n, count(distinct {t}) as ids from refmetas where {t} is not null having count(*) > 0" for t in TARGETS),
}
