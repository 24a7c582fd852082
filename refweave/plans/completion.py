"""Queries of keyed tables, files, rules, samples, density, smoothing, lattice counts and spacing."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.functions import text as T
from refweave.operators import classify as K
from refweave.operators import consolidate as C
from refweave.operators import evaluate as E
from refweave.operators import graph as G
from refweave.operators import language as L
from refweave.operators import lattice as A
from refweave.operators import relational as R
from refweave.operators import similarity as S
from refweave.operators.relabel import relabel
from refweave.plans.linkage import _EV, _MEMB, _NAMEFIT, _REPF, _evaluated, _features, _grouped, _members, _rep, _rep_features, _sql_features, _sql_vote
from refweave.plans.models import _CTX, NCHAR, _vocabulary
from refweave.sources import files as FI
from refweave.sources.keyed import KeyedTable, read_samples, write_samples
from refweave.sources.tables import cut, shared_folder, table
from refweave.streaming.incremental import counted_by_window

GATE = 25_000


def _t(spark, sf_dir, name) -> DataFrame:
    return table(spark, sf_dir, name)


def _new_folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


# --- tables by key and files ---


def _first_deliveries(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, sf_dir, "refmetas").select("linkid", "refid", "title", "year", "loaded_at")
    return R.first_wins(rows, ["linkid"], [F.col("loaded_at"), F.col("refid")]), rows


def snk1_overwrite(spark, sf_dir):
    """A table of first deliveries by link id, overwritten by all that arrived."""
    first, rows = _first_deliveries(spark, sf_dir)
    held = KeyedTable(spark, _new_folder(spark), "linkid")
    held.create(first)
    return held.overwrite(rows, [F.col("loaded_at"), F.col("refid")]).select("linkid", "refid", "title", "year")


def snk2_partial_update(spark, sf_dir):
    """Rows that get the group they are in and a flag, their other columns kept; members that never arrived change nothing."""
    held = KeyedTable(spark, _new_folder(spark), "refid")
    none = lambda kind: F.lit(None).cast(kind)
    held.create(_t(spark, sf_dir, "refmetas").select("refid", "linkid", none("string").alias("duplicate"), F.lit(False).alias("has_duplicate")))
    groups = _t(spark, sf_dir, "dupmembers").groupBy("refid").agg(F.min("duplicateid").alias("duplicate"))
    return held.update(groups.where("refid is not null").withColumn("has_duplicate", F.lit(True)))


def snk3_create_table(spark, sf_dir):
    """Labelled representations written as a table and read again."""
    held = KeyedTable(spark, _new_folder(spark), "repidindex")
    return held.create(_t(spark, sf_dir, "components").select("repidindex", "label").distinct())


def snk9_training_files(spark, sf_dir):
    """Training lines of matches and of other pairs, a file each, read together."""
    folder, m = _new_folder(spark), _t(spark, sf_dir, "repmatches").where("score is not null and verdict is not null").select("score", "verdict")
    for name, verdict in (("matches", 1), ("others", 0)):
        write_samples(m.where(F.col("verdict") == verdict), folder, name)
    return read_samples(spark, folder, "score double, verdict long")


def src5_interval(spark, sf_dir):
    """Labels of the representations of an interval of indexes."""
    c = _t(spark, sf_dir, "components").where("repidindex between 1000 and 2999 and label is not null")
    return c.groupBy("repidindex").agg(F.array_join(F.transform(F.array_sort(F.collect_set("label")), lambda x: x.cast("string")), " ").alias("labels"))


def src6_gold_file(spark, sf_dir):
    """Gold records as JSON lines, read as rows of record and duplicate."""
    folder, m = _new_folder(spark), _t(spark, sf_dir, "mentions").where("goldid is not null")
    lines = m.groupBy(F.col("mentionid").cast("string").alias("core_id")).agg(F.array_sort(F.collect_set(F.col("label").cast("string"))).alias("labelled_duplicates"), F.min("goldid").cast("string").alias("doi"))
    lines.write.json(folder)
    return FI.read_gold(spark, folder)


def src7_rules(spark, sf_dir):
    """Rows whose filled fields keep the rules of a constraints file."""
    needs, bars = FI.read_constraints("source + title\nissue + volume\npublisher1 - volume\n")
    fields = ("title", "source", "volume", "issue", "publisher1", "year")
    types = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in fields]))
    return _t(spark, sf_dir, "refmetas").where(A.licensed(types, needs, bars)).select("refid")


def src8_frequencies(spark, sf_dir):
    """A dictionary of title words and counts, written as lines and read again."""
    folder = _new_folder(spark)
    counts = _t(spark, sf_dir, "refmetas").select(F.explode(T.words(F.col("title"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    counts.select(F.format_string("%s %d", "w", "n").alias("value")).write.text(folder)
    return FI.read_frequencies(spark, folder)


# --- rows, rules and samples ---


def prj6_nested_pairs(spark, sf_dir):
    """Nested rows as attributes with their values, which one attribute may have many of."""
    person = lambda i: F.when(F.col(f"a{i}sur").isNotNull(), F.struct(F.col(f"a{i}sur").alias("surname"), F.col(f"a{i}first").alias("first")))
    docs = _t(spark, sf_dir, "refmetas").select("refid", "title", "year", F.struct("volume", "issue").alias("number"), F.array_compact(F.array(*[person(i) for i in range(1, 5)])).alias("authors"))
    pairs = FI.nested_pairs(docs, "refid")
    return pairs.groupBy("refid", "attr").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("vals"))


def prj12_rarity_fill(spark, sf_dir):
    """Sets of at most two features that are rarer than what they consist of, which get themselves as one more feature."""
    rows = _t(spark, sf_dir, "refmetas").select(_rep().alias("rep")).groupBy("rep").agg(F.count("*").alias("freq"))
    f = cut(_rep_features(spark, sf_dir))
    small = f.groupBy("rep").agg(F.array_sort(F.collect_list("f")).alias("fs")).where("size(fs) <= 2")
    single = f.groupBy(F.array("f").alias("fs")).agg(F.count("*").alias("n"))
    x, y = f.alias("x"), f.alias("y")
    double = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.f") < F.col("y.f"))).groupBy(F.array("x.f", "y.f").alias("fs")).agg(F.count("*").alias("n"))
    return small.join(single.union(double), "fs").join(rows, "rep").where("freq < n").select("rep", "freq", "n")


def prj18_relabel(spark, sf_dir):
    """Rows labelled within their source by the rank of their year; sources beyond the gate keep null."""
    rank = lambda rows: pd.factorize(rows["year"].fillna(1e9), sort=True)[0]
    done, _ = relabel(_t(spark, sf_dir, "refmetas").select("refid", "source", "year"), "source", "label", rank, GATE)
    return done.select("refid", "label")


def prj18_skipped(spark, sf_dir):
    """Groups that the gate leaves out, with their sizes: pipelines of more than a thousand rows."""
    return relabel(_t(spark, sf_dir, "refmetas").select("refid", "frompipeline"), "frompipeline", "label", lambda rows: pd.Series(0, rows.index), 1000)[1]


def jn4_target_rows(spark, sf_dir):
    """Rows with the row of the catalogue that their target id names, and both pipelines."""
    r = _t(spark, sf_dir, "refmetas")
    target = r.select(F.col("linkid").alias("crossrefid"), F.col("frompipeline").alias("target_pipeline"), F.col("refid").alias("target"))
    return r.where("crossrefid is not null").select("refid", "crossrefid", "frompipeline").join(target, "crossrefid").select("refid", "target", "frompipeline", "target_pipeline")


def jn11_combinations(spark, sf_dir):
    """Sets of minimal elements that stand over a set together, and the larger such sets they are part of, themselves included."""
    features = cut(_rep_features(spark, sf_dir))
    pairs = cut(G.contained(features))
    least = G.minimal(features, pairs).withColumnRenamed("rep", "sub")
    over = pairs.join(least, "sub").groupBy("sup").agg(F.array_join(F.array_sort(F.collect_set("sub")), ",").alias("comb"))
    combs = over.groupBy("comb").agg(F.count("*").alias("n"))
    parts = cut(combs.select(F.sha1("comb").alias("rep"), F.explode(F.split("comb", ",")).alias("f")))
    return G.contained(parts).select("sub", "sup").union(parts.select("rep", F.col("rep").alias("sup")).distinct())


def wn5_by_size(spark, sf_dir):
    """Sets of features numbered by size, then by id."""
    sized = _rep_features(spark, sf_dir).groupBy("rep").agg(F.count("*").alias("size")).withColumn("by", F.concat(F.format_string("%06d", "size"), F.lit(" "), "rep"))
    return R.dense_numbers(sized, "by", "place").select("rep", "size", "place")


def wn9_pair_samples(spark, sf_dir):
    m = _t(spark, sf_dir, "mentions").select(F.col("mentionid").alias("mention"), F.col("label"))
    return E.pair_samples(m)


def st4_set_algebra(spark, sf_dir):
    """Words of titles and printed references: in either, in both, only in the title, and whether the title adds none."""
    t, r = F.array_distinct(T.words(F.col("title"))), F.array_distinct(T.words(F.col("refstring")))
    return _t(spark, sf_dir, "refmetas").select("refid", F.size(F.array_union(t, r)).alias("either"), F.size(F.array_intersect(t, r)).alias("both"), F.size(F.array_except(t, r)).alias("only_title"), (F.size(F.array_except(t, r)) == 0).alias("part"))


# --- evaluation ---


def ag8_core_negative(spark, sf_dir):
    return E.negative_class(E.core_evaluation(_evaluated(spark, sf_dir)))


def ag10_minimal_stats(spark, sf_dir):
    features = cut(_rep_features(spark, sf_dir))
    pairs = cut(G.contained(features))
    least = G.minimal(features, pairs).withColumnRenamed("rep", "sub")
    return E.minimal_stats(cut(pairs.join(least, "sub").select(F.col("sub").alias("minel"), F.col("sup").alias("superset"))))


def ag20_weighted_gini(spark, sf_dir):
    """Inequality of the representations per label, weighted by the mentions of the label."""
    x = _t(spark, sf_dir, "components").where("label is not null").groupBy("label").agg(F.countDistinct("repidindex").alias("x"))
    w = _t(spark, sf_dir, "mentions").where("label is not null").groupBy("label").agg(F.countDistinct("mentionid").alias("weight"))
    return E.weighted_gini(x.join(w, "label"))


def ag22_context_sides(spark, sf_dir):
    """Distinct continuations of every history and distinct histories of every continuation, with their occurrences."""
    c = cut(L.context_counts(_t(spark, sf_dir, "refmetas"), "refstring", NCHAR))
    side = lambda name, own: c.groupBy("across", F.col(own).alias("gram")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).select("across", F.lit(name).alias("side"), "gram", "kinds", "n")
    return side("history", "h").union(side("continuation", "w"))


# --- scalars ---


def sc19_hash(spark, sf_dir):
    """The 64-bit byte hash of every distinct word of the titles, as hexadecimal digits."""
    return S.hashed_words(_t(spark, sf_dir, "refmetas").select(F.explode(T.words(F.col("title"))).alias("word")).distinct())


def sc29_curves(spark, sf_dir):
    x = F.col("score")
    return _t(spark, sf_dir, "repmatches").where("score >= 0").select("matchid", F.round(T.root_curve(x, 2.0, 3.0, 0.5), 6).alias("root"), F.round(T.double_logistic_curve(x, 1.0, 4.0, 0.1), 6).alias("double"))


def sc31_serialised(spark, sf_dir):
    """Author, year and source of every row as serialised feature pairs."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("type"), F.col(c).cast("string").alias("value")))
    return _t(spark, sf_dir, "refmetas").select("refid", T.serialised(F.array_compact(F.array(one("a1sur"), one("source"), one("year")))).alias("shown"))


def sc35_spacing(spark, sf_dir):
    """Titles with words put together that are hardly ever apart."""
    refs = _t(spark, sf_dir, "refmetas")
    return L.separations(refs.select("refid", "title"), "title", cut(L.context_counts(refs, "title", NCHAR))).select("refid", "corrected")


def _two_names(spark, sf_dir, kind: str) -> DataFrame:
    names = F.regexp_replace("a1first", "_", " ")
    return _t(spark, sf_dir, "refmetas").where("a1sur is not null and a1first is not null").select("refid", K.measured(kind, F.col("a1sur"), names).alias(kind))


def sc23_unmatched(spark, sf_dir):
    return _two_names(spark, sf_dir, "unmatched")


def sc24_costs(spark, sf_dir):
    return _two_names(spark, sf_dir, "cost")


def sc25_similar(spark, sf_dir):
    return _two_names(spark, sf_dir, "similar")


def jn15_assigned(spark, sf_dir):
    """Least total cost of an assignment between the parts of the names."""
    return _two_names(spark, sf_dir, "assigned")


def sc13_word_bigrams(spark, sf_dir):
    """Bigrams of the titles' known words, corrected and taken apart where need be."""
    _, known = _vocabulary(spark, sf_dir)
    return L.word_bigrams(_t(spark, sf_dir, "refmetas").select("refid", "title"), "refid", "title", known, tuple(T.STOPWORDS)).select("refid", F.array_join("terms", "|").alias("terms"))


def ag16_majority_names(spark, sf_dir):
    """The most supported name at every author's place of a group."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), *[F.col(f"a{i}{c}").alias(c) for c in ("sur", "init", "first")]) for i in range(1, 5)]))
    rows = _members(spark, sf_dir).select("grp", "refid", at.alias("n")).select(F.concat_ws("#", "grp", "n.pos").alias("grp"), "refid", "n.sur", "n.init", "n.first").where("coalesce(sur, init, first) is not null")
    return C.majority_name(rows, ["sur", "init", "first"], "refid")


def stream_window_counts(spark, sf_dir):
    """Events per type and day, as the streaming operator counts them."""
    return counted_by_window(_t(spark, sf_dir, "events"))


# --- groups and lattices ---


def gr4_smoothing(spark, sf_dir):
    f = _rep_features(spark, sf_dir).withColumnRenamed("rep", "rec")
    return S.smoothing(f).select("f", "g", F.round("weight", 6).alias("weight"))


def gr9_density(spark, sf_dir):
    """Rows of a block clustered by density over the likeness of titles."""
    f = cut(_features(_grouped(spark, sf_dir)).where("ftype = 'title'"))
    sims = S.type_similarities(f).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return S.dbscan(sims, f.select("rec"), 0.5)


def gr16_fallback_labels(spark, sf_dir):
    """The smallest label of every representation, or a number beyond all labels."""
    c = _t(spark, sf_dir, "components").where("repidindex is not null").groupBy("repidindex").agg(F.min("label").alias("label"))
    most = _t(spark, sf_dir, "components").agg(F.coalesce(F.max("label"), F.lit(0)).alias("most"))
    return c.crossJoin(most).select("repidindex", F.coalesce("label", F.col("most") + 1 + F.col("repidindex")).alias("label"))


def _counted_sets(spark, sf_dir) -> DataFrame:
    """(fs, obs): sets of author, year and source with the rows that have them."""
    f = _rep_features(spark, sf_dir).groupBy("rep").agg(F.collect_list("f").alias("fs"))
    rows = _t(spark, sf_dir, "refmetas").select(_rep().alias("rep")).groupBy("rep").agg(F.count("*").alias("obs"))
    return f.join(rows, "rep").select("rep", "fs", "obs")


def gr21_expanded(spark, sf_dir):
    return A.expanded(_counted_sets(spark, sf_dir)).select(F.array_join("fs", "|").alias("part"), "obs", "car")


def gr24_discounted(spark, sf_dir):
    """Counts of sets, half of each handed on to the sets right above."""
    features = cut(_rep_features(spark, sf_dir))
    pairs = cut(G.contained(features))
    nodes = G.observed_and_carried(_counted_sets(spark, sf_dir).select("rep", "obs"), pairs)
    return A.discounted(nodes, G.hasse(pairs), 0.5).select("rep", F.round("obs", 6).alias("obs"))


QUERIES: dict = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

_MINEL = "mp as materialized (select sub as minel, sup as superset from cont where sub not in (select sup from cont))"
_OBS = "obs as materialized (select sha1(array_to_string(fs, '|')) as rep, fs, count(*) as obs from (select [x for x in ['a:' || a, 'y:' || y, 's:' || s] if x is not null] as fs from (select {fold} as a, cast(year as varchar) as y, lower(source) as s from refmetas)) where len(fs) > 0 group by 1, 2)"


def _obs() -> str:
    from refweave.plans.scalars import _sql_fold

    return _OBS.format(fold=_sql_fold("lower(a1sur)"))


_T, _R = (f"coalesce(list_distinct(regexp_extract_all(lower({c}), '{T.WORD}')), [])" for c in ("title", "refstring"))
_TITLE_CTX = _CTX.replace("refstring", "title")
_LONG_FIELDS = " union all ".join(
    [f"select refid, '_{c}' as attr, cast({c} as varchar) as v from refmetas where {c} is not null" for c in ("title", "year")]
    + [f"select refid, '_number_{c}', {c} from refmetas where {c} is not null" for c in ("volume", "issue")]
    + [f"select refid, 'authors_{n}', a{i}{c} from refmetas where a{i}sur is not null and a{i}{c} is not null" for i in range(1, 5) for n, c in (("surname", "sur"), ("first", "first"))]
)

_NAME_ROWS = " union all ".join(f"select grp || '#{i}' as grp, refid, a{i}sur as sur, a{i}init as init, a{i}first as first from m0 where coalesce(a{i}sur, a{i}init, a{i}first) is not null" for i in range(1, 5))

SQL = {
    "ag16_majority_names": f"with {_MEMB.replace('memb as', 'm0 as', 1)}, memb as ({_NAME_ROWS}), {_sql_vote(['sur', 'init', 'first'], _NAMEFIT(['sur', 'init', 'first']))} select * from won",
    "stream_window_counts": "select date_trunc('day', ts) as start, event_type, count(*) as n from events where ts is not null group by 1, 2",
    "snk1_overwrite": "select linkid, refid, title, year from refmetas where linkid is not null qualify row_number() over (partition by linkid order by loaded_at desc, refid desc) = 1",
    "snk2_partial_update": "select refid, linkid, d as duplicate, d is not null as has_duplicate from refmetas left join (select refid, min(duplicateid) as d from dupmembers group by refid) using (refid)",
    "snk3_create_table": "select distinct repidindex, label from components where repidindex is not null",
    "snk9_training_files": "select score, verdict from repmatches where score is not null and verdict in (0, 1)",
    "src5_interval": "select repidindex, array_to_string(list_sort(list(distinct label)), ' ') as labels from components where repidindex between 1000 and 2999 and label is not null group by repidindex",
    "src6_gold_file": "select cast(mentionid as varchar) as core_id, cast(label as varchar) as duplicate from (select distinct mentionid, label from mentions where goldid is not null) x where label is not null or mentionid not in (select mentionid from mentions where goldid is not null and label is not null)",
    "src7_rules": "select refid from refmetas where (title is not null)::int + (source is not null)::int + (volume is not null)::int + (issue is not null)::int + (publisher1 is not null)::int + (year is not null)::int >= 2 and (source is null or title is not null) and (issue is null or volume is not null) and not (publisher1 is not null and volume is not null)",
    "src8_frequencies": f"select w as term, count(*) as freq from (select unnest(regexp_extract_all(lower(title), '{T.WORD}')) as w from refmetas) group by w",
    "prj6_nested_pairs": f"select refid, attr, array_to_string(list_sort(list(v)), '|') as vals from ({_LONG_FIELDS}) group by refid, attr",
    "prj12_rarity_fill": f"with {_REPF}, {_obs()}, two as (select x.f as f1, y.f as f2, count(*) as n from feats x join feats y on x.rep = y.rep and x.f < y.f group by all), one as (select f, count(*) as n from feats group by f), s as (select rep, list_sort(fs) as fs, obs as freq from obs where len(fs) <= 2), c as (select rep, freq, n from s join one on len(fs) = 1 and f = fs[1] union all select rep, freq, n from s join two on len(fs) = 2 and f1 = fs[1] and f2 = fs[2]) select rep, freq, n from c where freq < n",
    "prj18_relabel": f"with n as (select source, count(*) as k from refmetas where source is not null group by source) select refid, case when k <= {GATE} then source || '_' || (dense_rank() over (partition by r.source order by year nulls last) - 1) end as label from refmetas r left join n using (source)",
    "prj18_skipped": "select frompipeline, count(*) as size from refmetas where frompipeline is not null group by 1 having count(*) > 1000",
    "jn4_target_rows": "select r.refid, t.refid as target, r.frompipeline, t.frompipeline as target_pipeline from refmetas r join refmetas t on r.crossrefid = t.linkid",
    "jn11_combinations": f"with {_REPF}, {_MINEL}, o as (select superset, list_sort(list(minel)) as ms from mp group by superset), c as materialized (select distinct ms, sha1(array_to_string(ms, ',')) as id from o), e as (select id, len(ms) as n, unnest(ms) as m from c) select x.id as sub, y.id as sup from e x join e y on x.m = y.m group by x.id, y.id, x.n having count(*) = x.n",
    "wn5_by_size": f"with {_REPF} select rep, n as size, row_number() over (order by n, rep) as place from sizes",
    "wn9_pair_samples": """with m as materialized (select distinct mentionid as mention, label from mentions where label is not null), r as materialized (select *, row_number() over (partition by label order by mention) as r, count(*) over (partition by label) as n from m),
        lab as (select label, max(n) as n from r group by label), p as (select label, n, least(n * (n - 1) // 2, 1000) as pairs from lab where n > 1), t as (select label, n from p qualify coalesce(sum(pairs) over (order by label rows between unbounded preceding and 1 preceding), 0) < 10000),
        eq as (select x.mention as a, y.mention as b from r x join t using (label) join r y on y.label = x.label and x.r < y.r and y.r <= 1001 and (x.r - 1) * t.n - (x.r - 1) * x.r // 2 + y.r - x.r - 1 < 1000),
        l as (select label, n, row_number() over (order by label) as i, count(*) over () as k from lab), q as (select a.label as l1, b.label as l2, b.n as n2, (a.i - 1) * a.k - (a.i - 1) * a.i // 2 + b.i - a.i - 1 as place, least(a.n * b.n, 10) as pairs from l a join l b on a.i < b.i where (a.i - 1) * a.k - (a.i - 1) * a.i // 2 + b.i - a.i - 1 < 10000),
        u as (select * from q qualify coalesce(sum(pairs) over (order by place rows between unbounded preceding and 1 preceding), 0) < 10000),
        ne as (select x.mention as a, y.mention as b from u join r x on x.label = l1 and x.r <= 10 join r y on y.label = l2 and (x.r - 1) * n2 + y.r - 1 < 10 and y.r <= 10)
        select a, b, true as equal from eq union all select a, b, false from ne""",
    "st4_set_algebra": f"select refid, len(list_distinct(list_concat({_T}, {_R}))) as either, len(list_intersect({_T}, {_R})) as both, len({_T}) - len(list_intersect({_T}, {_R})) as only_title, len({_T}) = len(list_intersect({_T}, {_R})) as part from refmetas",
    "ag8_core_negative": f"""with r as (select distinct mention, gold, label from {_EV} where gold is not null and label is not null), m as (select *, count(*) over (partition by gold, label) as gl, count(*) over (partition by gold) as g, count(*) over (partition by label) as l from r),
        c as (select count(*) filter (l > 1 and gl < g) as fp, count(*) filter (l = 1 and g = 1) as tn, count(*) filter (l = 1 and g > 1) as fn from m) select floor(10000 * tn / nullif(tn + fn, 0)) / 100 as precision, floor(10000 * tn / nullif(tn + fp, 0)) / 100 as recall from c""",
    "ag10_minimal_stats": f'with {_REPF}, {_MINEL}, k as (select superset, count(*) as k from mp group by superset) select minel, count(*) as "any", count(*) filter (k > 1) as multi, count(*) filter (k = 1) as single, round(count(*) filter (k > 1) / count(*), 6) as prob from mp join k using (superset) group by minel',
    "ag20_weighted_gini": "with x as (select label, count(distinct repidindex) as x from components where label is not null group by label), w as (select label, count(distinct mentionid) as w from mentions where label is not null group by label), h as (select x, sum(w) as w from x join w using (label) group by x), c as (select sum(w) over o as w1, sum(x * w) over o as xw1, coalesce(sum(w) over b, 0) as w0, coalesce(sum(x * w) over b, 0) as xw0 from h window o as (order by x rows between unbounded preceding and current row), b as (order by x rows between unbounded preceding and 1 preceding)) select round(sum(xw1::double * w0 - xw0::double * w1) / (max(xw1)::double * max(w1)), 6) as gini from c",
    "ag22_context_sides": f"with {_CTX} select across, 'history' as side, h as gram, count(*) as kinds, sum(n) as n from cnt group by across, h union all select across, 'continuation', w, count(*), sum(n) from cnt group by across, w",
    "sc29_curves": "select matchid, round(2.0 * power(score, 1.0 / 3.0) - 0.5, 6) as root, round(1.0 / (1 + exp(-1.0 * 1.0 * score) * (1.0 / 0.1 - 1)) + 1.0 / (1 + exp(-0.25 * 1.0 * score) * (1.0 / (0.1 / 8000.0) - 1)), 6) as \"double\" from repmatches where score >= 0",
    "sc31_serialised": "select refid, array_to_string([x for x in ['a1sur&\"' || a1sur || '\"', 'source&\"' || source || '\"', 'year&\"' || year || '\"'] if x is not null], ';') as shown from refmetas",
    "sc35_spacing": f"""with {_TITLE_CTX}, su as (select sum(n) filter (not across) as s1, sum(n) filter (across) as s2 from cnt), l as (select h, sum(n) as n from cnt where across group by h), r as (select w, sum(n) as n from cnt where across group by w),
        g as (select c.h, c.w from cnt c join l using (h) join r using (w) cross join su left join cnt i on not i.across and i.h = c.h and i.w = c.w where c.across and (l.n / s2 * (r.n / s2)) / (l.n / s2 * (r.n / s2) + coalesce(i.n / s1, 0)) < 0.01),
        ws as (select refid, title, list_filter(regexp_split_to_array(title, '\\s+'), lambda x: length(x) > 0) as ws from refmetas), p as (select refid, i, ws[i] as word, case when i > 1 then ws[i - 1] end as b from (select refid, ws, unnest(range(1, len(ws) + 1)) as i from ws)),
        j as (select refid, string_agg(case when i = 1 or g.h is not null then word else ' ' || word end, '' order by i) as c from p left join g on g.h = right(lower(b), {NCHAR}) and g.w = left(lower(word), {NCHAR}) group by refid)
        select refid, case when title is not null then coalesce(c, '') end as corrected from ws left join j using (refid)""",
    "gr4_smoothing": f"with {_REPF}, fr as (select f, count(*) as k from feats group by f), m as (select x.f, y.f as g, sum(1.0 / n) as met from feats x join feats y on x.rep = y.rep join sizes on sizes.rep = x.rep group by 1, 2), ff as (select m.f, g, met / k as w from m join fr on fr.f = g) select ff.f, ff.g, round(ff.w / d.w, 6) as weight from ff join ff d on d.f = ff.f and d.g = ff.f where ff.w / d.w >= 0.5",
    "gr9_density": f"""with recursive {_sql_features()}, sim as (select a, b, max(i / (na + nb - i)) as sim from s where ftype = 'title' group by a, b), near as materialized (select a, b from sim where 1 - sim * sim <= 0.5), bo as materialized (select a, b from near union select b, a from near),
        core as materialized (select a from bo group by a having count(*) >= 2), lk as materialized (select bo.a as x, bo.b as y from bo join core c on c.a = bo.a join core d on d.a = bo.b), walk as (select a as node, a as seen from core union select w.node, l.y from walk w join lk l on w.seen = l.x),
        cl as (select node, min(seen) as c from walk group by node), be as (select bo.b as rec, min(c) as c from bo join cl on cl.node = bo.a group by 1), nodes as (select distinct rec from f where ftype = 'title')
        select nodes.rec, coalesce(cl.c, be.c) as cluster from nodes left join cl on cl.node = nodes.rec left join be on be.rec = nodes.rec""",
    "gr16_fallback_labels": "select repidindex, coalesce(min(label), (select max(label) from components) + 1 + repidindex) as label from components where repidindex is not null group by repidindex",
    "gr21_expanded": f"with recursive {_obs()}, sub as (select rep, list_sort(fs) as fs from obs union select rep, list_filter(fs, lambda x: x <> d) from (select rep, fs, unnest(fs) as d from sub) where len(fs) > 1), car as (select fs, sum(obs) as car from sub join (select rep, obs from obs) using (rep) group by fs), own as (select list_sort(fs) as fs, sum(obs) as obs from obs group by 1) select array_to_string(fs, '|') as part, coalesce(obs, 0) as obs, car from car left join own using (fs)",
    "gr24_discounted": f"""with {_REPF}, {_obs()}, has as (select sub, sup from cont c where not exists (select 1 from cont x join cont y on x.sup = y.sub where x.sub = c.sub and y.sup = c.sup)),
        n as materialized (select rep, obs, obs + coalesce((select sum(b.obs) from cont join obs b on b.rep = sup where sub = o.rep), 0) as car from obs o),
        w as materialized (select sub, sup, y.car / x.car as w from has join n x on x.rep = sub join n y on y.rep = sup union all select rep, rep, obs / car from n), t as (select sub, sum(w) as t from w group by sub),
        gain as (select sup as rep, sum(obs * 0.5 * w / t) as gain from w join t using (sub) join n on n.rep = sub group by sup) select rep, round(obs * 0.5 + coalesce(gain, 0), 6) as obs from n left join gain using (rep)""",
}
