"""Queries of the joins, graph, scoring, evaluation and consolidation operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refweave.functions import text as T
from refweave.operators import consolidate as C
from refweave.operators import evaluate as E
from refweave.operators import graph as G
from refweave.operators import relational as R
from refweave.operators import similarity as S
from refweave.plans.scalars import TARGETS, _bundled, _sql_fold, _sql_ngrams, _sql_repid
from refweave.sources.tables import cut, table

MAX_LABEL, MAX_GOLD = 50, 20


def _t(spark, sf_dir, name) -> DataFrame:
    return table(spark, sf_dir, name)


# --- joins and set operations ---


def jn1_label_lookup(spark, sf_dir):
    """Every row of refmetas with the labels of its mentions."""
    labels = _t(spark, sf_dir, "mentions").select(F.col("originalid").alias("linkid"), "label").distinct()
    return _t(spark, sf_dir, "refmetas").select("refid", "linkid").join(labels, "linkid", "left").select("refid", "label")


def jn2_canonical_lookup(spark, sf_dir):
    """Rows with the duplicate group that lists them."""
    return _t(spark, sf_dir, "refmetas").select("refid").join(_t(spark, sf_dir, "dupmembers").distinct(), "refid", "left").select("refid", "duplicateid")


def jn3_chain(spark, sf_dir):
    """Labels to representations to mentions to references, counted per label."""
    m = _t(spark, sf_dir, "mentions").where("repid is not null").select(F.lower(F.trim("repid")).alias("repid"), "originalid", "label").distinct()
    r = _t(spark, sf_dir, "refmetas").select(F.col("linkid").alias("originalid"), "frompipeline")
    c = _t(spark, sf_dir, "components").where("label is not null").select("label").distinct()
    return m.join(c, "label").join(r, "originalid").groupBy("label").agg(F.countDistinct("repid").alias("reps"), F.countDistinct("frompipeline").alias("pipelines"), F.count("*").alias("n"))


def jn4_target_types(spark, sf_dir):
    """Pipelines of the rows matched to a target beside the pipelines of the catalogue's trust."""
    p = _t(spark, sf_dir, "pipelines")
    return _t(spark, sf_dir, "refmetas").join(p, F.col("frompipeline") == F.col("pipeline")).groupBy("pipeline", "trust").agg(F.count("*").alias("n"), F.count("crossrefid").alias("with_crossref"))


def jn12_semi(spark, sf_dir):
    return _t(spark, sf_dir, "refmetas").join(_t(spark, sf_dir, "dupmembers"), "refid", "left_semi").select("refid")


def jn13_not_in(spark, sf_dir):
    """Null-aware: labels of mentions that no component has, by list; nothing is sure of the list that holds a null."""
    for name in ("components", "mentions"):
        _t(spark, sf_dir, name).createOrReplaceTempView(f"refweave_{name}")
    outside = "select distinct label from refweave_mentions where label not in (select label from refweave_components{})"
    return spark.sql(f"select 'filled' as list, label from ({outside.format(' where label is not null')}) union all select 'with null', label from ({outside.format('')})")


def jn14_anti(spark, sf_dir):
    """References of mentions that never arrived."""
    m = _t(spark, sf_dir, "mentions").select(F.col("originalid").alias("linkid")).distinct()
    return m.join(_t(spark, sf_dir, "refmetas").select("linkid"), "linkid", "left_anti")


def st1_union(spark, sf_dir):
    a, b = _t(spark, sf_dir, "components").select("label"), _t(spark, sf_dir, "mentions").select("label")
    return a.union(b).distinct()


def st3_except_intersect(spark, sf_dir):
    """From left to right: (A except B) intersect C."""
    m = _t(spark, sf_dir, "mentions")
    a = _t(spark, sf_dir, "components").select("label")
    return R.except_then_intersect(a, m.where("goldid is not null").select("label"), m.where("runno = 1").select("label"))


def wn1_first_wins(spark, sf_dir):
    """One row per link id: the most trusted pipeline's, the earliest loaded, the smallest refid."""
    refs = _t(spark, sf_dir, "refmetas").select("linkid", "refid", "loaded_at")
    return R.first_wins(refs, ["linkid"], [F.col("loaded_at"), F.col("refid")]).select("linkid", "refid")


def wn2_dense_index(spark, sf_dir):
    names = _t(spark, sf_dir, "refmetas").select("source").where("source is not null").distinct()
    return R.dense_numbers(names, "source", "sourceindex")


def wn6_top_labels(spark, sf_dir):
    return _t(spark, sf_dir, "mentions").where("label is not null").groupBy("label").agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "label").limit(20)


def wn8_first_terms(spark, sf_dir):
    """The first six words of the title, nulls where there are fewer."""
    own = T.words(F.col("title"))
    return _t(spark, sf_dir, "refmetas").select("refid", *[F.get(own, F.lit(i)).alias(f"term{i + 1}") for i in range(6)])


def wn9_capped_samples(spark, sf_dir):
    """Up to ten mentions per label, the smallest ids: a sampling operator."""
    m = _t(spark, sf_dir, "mentions").where("label is not null").select("label", "mentionid").distinct()
    # The cap is applied within hashed shares of a label first, so that no task sorts a whole heavy label.
    share = Window.partitionBy("label", F.pmod(F.xxhash64("mentionid"), F.lit(64))).orderBy("mentionid")
    few = m.withColumn("r", F.row_number().over(share)).where("r <= 10").drop("r")
    return few.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("mentionid"))).where("r <= 10").drop("r")


# --- aggregation and evaluation ---


def ag1_distinct_counts(spark, sf_dir):
    return _t(spark, sf_dir, "refmetas").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))


def _evaluated(spark, sf_dir) -> DataFrame:
    """Mentions with a gold id: (mention, gold, label, rep)."""
    m = _t(spark, sf_dir, "mentions")
    return m.select(F.col("mentionid").alias("mention"), F.col("goldid").alias("gold"), "label", F.nullif(F.lower(F.trim("repid")), F.lit("")).alias("rep")).distinct()


def ag3_pair_prf(spark, sf_dir):
    return E.pair_prf(_evaluated(spark, sf_dir), "gold", "label")


def ag4_group_sizes(spark, sf_dir):
    return E.upper_median(_t(spark, sf_dir, "mentions"), "label")


def ag5_capped_evaluation(spark, sf_dir):
    rows = _evaluated(spark, sf_dir)
    sizes = _t(spark, sf_dir, "components").where("label is not null").groupBy("label").agg(F.countDistinct("repidindex").alias("reps"))
    c = E.capped_counts(rows, sizes, MAX_LABEL, MAX_GOLD)
    return c.select("t", "p", "tp", E.truncated_percent(F.col("tp"), F.col("p")).alias("precision"), E.truncated_percent(F.col("tp"), F.col("t")).alias("recall"))


def ag6_distinct_evaluation(spark, sf_dir):
    """Oversized labels, counted on mentions, stand as singletons."""
    rows = _evaluated(spark, sf_dir).where("gold is not null and label is not null").select("mention", "gold", "label").distinct()
    big = rows.groupBy("label").agg(F.countDistinct("mention").alias("n")).where(F.col("n") > MAX_LABEL).select("label", F.lit(True).alias("big"))
    one = rows.join(big, "label", "left").select("gold", F.when(F.col("big"), F.concat(F.lit("m"), F.col("mention").cast("string"))).otherwise(F.concat(F.lit("l"), F.col("label").cast("string"))).alias("auto"))
    return E.pair_counts(one)


def ag7_size_stats(spark, sf_dir):
    m = _t(spark, sf_dir, "mentions").where("label is not null").groupBy("label").agg(F.count("*").alias("freq"))
    return m.agg(F.max("freq").alias("largest"), F.round(F.sum("freq") / F.count("*"), 6).alias("average"))


def ag8_core_evaluation(spark, sf_dir):
    return E.core_evaluation(_evaluated(spark, sf_dir))


def ag9_size_boundaries(spark, sf_dir):
    return E.size_boundaries(_t(spark, sf_dir, "components"), "label")


def ag19_ratios(spark, sf_dir):
    return E.ratios(_evaluated(spark, sf_dir), "gold", "rep")


def ag20_gini(spark, sf_dir):
    return E.gini(_t(spark, sf_dir, "components"), "label")


def ag23_document_flags(spark, sf_dir):
    """Per document: distinct labels of its references, how many, whether there are any."""
    refs = _t(spark, sf_dir, "refmetas").select("linkid", F.regexp_extract("linkid", "_(doc[0-9]+)_ref_", 1).alias("doc")).where("doc <> ''").distinct()
    m = _t(spark, sf_dir, "mentions").select(F.col("originalid").alias("linkid"), "label").where("label is not null").distinct()
    docs = refs.join(m, "linkid", "left").groupBy("doc").agg(F.countDistinct("label").alias("num_labels"))
    return docs.withColumn("has_labels", F.col("num_labels") > 0)


def ag24_merged_references(spark, sf_dir):
    """Distinct duplicate groups of every document by their first place in it."""
    r = _t(spark, sf_dir, "refmetas").select("refid", F.regexp_extract("linkid", "_(doc[0-9]+)_ref_([0-9]+)$", 1).alias("doc"), F.regexp_extract("linkid", "_(doc[0-9]+)_ref_([0-9]+)$", 2).try_cast("int").alias("pos"))
    return r.where("doc <> ''").join(_t(spark, sf_dir, "dupmembers").distinct(), "refid").groupBy("doc", "duplicateid").agg(F.min("pos").alias("first_pos"))


# --- sets, orders and components ---


def _rep_tags() -> Column:
    """Author, year and source of a row of refmetas, as tagged features."""
    parts = {"a": T.author_norm(F.col("a1sur")), "y": F.col("year").cast("string"), "s": F.lower("source")}
    return F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{t}:"), c)) for t, c in parts.items()]))


def _rep() -> Column:
    """The id of a row's set of features."""
    return F.sha1(F.array_join(_rep_tags(), "|"))


def _rep_features(spark, sf_dir) -> DataFrame:
    """(rep, f): author, year and source of every distinct combination of them."""
    fs = _t(spark, sf_dir, "refmetas").select(_rep_tags().alias("fs")).distinct()
    return fs.select(F.sha1(F.array_join("fs", "|")).alias("rep"), F.explode("fs").alias("f")).distinct()


def jn7_containment(spark, sf_dir):
    return G.contained(_rep_features(spark, sf_dir))


def gr19_minimal(spark, sf_dir):
    features = cut(_rep_features(spark, sf_dir))
    return G.minimal(features, G.contained(features))


def gr18_hasse(spark, sf_dir):
    features = cut(_rep_features(spark, sf_dir))
    return G.hasse(cut(G.contained(features)))


def gr20_observed_carried(spark, sf_dir):
    features = cut(_rep_features(spark, sf_dir))
    counts = features.groupBy("rep").agg(F.count("*").alias("obs"))
    return G.observed_and_carried(counts, G.contained(features))


def ag10_minimal_multiplicity(spark, sf_dir):
    """How many minimal sets every other set contains."""
    features = cut(_rep_features(spark, sf_dir))
    pairs = cut(G.contained(features))
    least = G.minimal(features, pairs).withColumnRenamed("rep", "sub")
    per = pairs.join(least, "sub").groupBy("sup").agg(F.count("*").alias("minels"))
    return per.groupBy("minels").agg(F.count("*").alias("n_sets"))


def gr13_poset_blocks(spark, sf_dir):
    return G.poset_blocks(cut(_rep_features(spark, sf_dir)))


def gr14_single_feature_blocks(spark, sf_dir):
    return _rep_features(spark, sf_dir).groupBy("f").agg(F.countDistinct("rep").alias("reps"))


def gr6_components(spark, sf_dir):
    edges = _t(spark, sf_dir, "repmatches").where("verdict = 1").select(F.col("repidindex_a").alias("a"), F.col("repidindex_b").alias("b"))
    return G.components(edges)


def gr10_gold_components(spark, sf_dir):
    """Rows linked by a shared target id: the smallest row of each group."""
    refs = _t(spark, sf_dir, "refmetas")
    ids = refs.select("refid", F.explode(F.array(*[F.when(F.col(t).isNotNull(), F.concat(F.lit(f"{t}:"), F.col(t))) for t in TARGETS])).alias("target")).where("target is not null")
    # Every target is linked to its smallest row: a star, not all pairs.
    least = ids.groupBy("target").agg(F.min("refid").alias("b"))
    return G.components(ids.join(least, "target").select(F.col("refid").alias("a"), "b"))


def gr16_apply_components(spark, sf_dir):
    """Mentions with a label for each: their own, or one made of the representation."""
    m = _evaluated(spark, sf_dir)
    return m.select("mention", F.coalesce(F.col("label").cast("string"), F.concat(F.lit("s_"), F.coalesce("rep", F.col("mention").cast("string")))).alias("label")).distinct()


def gr26_heaviest_parent(spark, sf_dir):
    e = _t(spark, sf_dir, "repmatches").where("score is not null and repidindex_a <> repidindex_b").select(F.col("repidindex_a").alias("child"), F.col("repidindex_b").alias("parent"), F.col("score").alias("weight"))
    return G.heaviest_parent(e)


# --- scoring inside groups ---


def _grouped(spark, sf_dir) -> DataFrame:
    """Rows of refmetas with their duplicate group's block as ``grp``."""
    members = _t(spark, sf_dir, "dupmembers").select("refid", F.regexp_extract("duplicateid", "^([^_]*)_", 1).alias("grp")).distinct()
    return _t(spark, sf_dir, "refmetas").join(members, "refid")


def _parts(of) -> dict[str, list[Column]]:
    """By feature type the arrays of ``of(ftype, field, value)`` of a row; where a field is a plain value, its absence is a value too."""
    one = lambda ftype, field, values: F.transform(values, lambda v: of(ftype, field, v))
    plain = lambda ftype, field: one(ftype, field, F.array(F.coalesce(F.col(field).cast("string"), F.lit("None"))))
    grams = lambda ftype, field: one(ftype, field, F.array_distinct(T.ngrams(F.col(field), 3)))
    parts = {"title": [grams("title", "title")], "source": [grams("source", "source")], "pubnumber": [plain("pubnumber", c) for c in ("issue", "volume", "year")]}
    for t, kind, field in (("surname", grams, "sur"), ("init", plain, "init"), ("first", grams, "first")):
        parts[t] = [kind(t, f"a{i}{field}") for i in range(1, 3)]
    return parts | {"editor": [grams("editor", "e1sur")], "publisher": [grams("publisher", "publisher1")]}


def _features(rows: DataFrame) -> DataFrame:
    """(grp, rec, ftype, value) of every row."""
    parts = _parts(lambda ftype, field, v: F.struct(F.lit(ftype).alias("ftype"), F.concat(F.lit(f"{field}="), v).alias("value")))
    all_parts = F.concat(*[F.coalesce(p, F.array()) for own in parts.values() for p in own])
    return rows.select("grp", F.col("refid").alias("rec"), F.explode(all_parts).alias("f")).select("grp", "rec", "f.ftype", "f.value").distinct()


def _hashed_features(rows: DataFrame) -> DataFrame:
    """(grp, rec, <types>): the same as hashes, an array for each type; made after the rows of a group came together."""
    parts = _parts(lambda ftype, field, v: F.xxhash64(F.lit(field), v))
    return rows.repartition("grp").select("grp", F.col("refid").alias("rec"), *[F.concat(*own).alias(t) for t, own in parts.items()])


def gr2_type_similarities(spark, sf_dir):
    return S.type_similarities(_features(_grouped(spark, sf_dir))).select("a", "b", "ftype", F.round("sim", 6).alias("sim"))


def gr3_similarity_kinds(spark, sf_dir):
    """Dice, overlap and cosine of the titles of every pair of a block."""
    f = _features(_grouped(spark, sf_dir)).where("ftype = 'title'")
    return S.type_similarities(f, ("dice", "overlap", "cosine")).select("a", "b", *[F.round(kind, 6).alias(kind) for kind in ("dice", "overlap", "cosine")])


def gr5_pair_scores(spark, sf_dir):
    return S.pair_scores(_features(_grouped(spark, sf_dir))).select("a", "b", F.round("score", 6).alias("score"))


def gr5_logistic_clusters(spark, sf_dir):
    return S.logistic_clusters(_features(_grouped(spark, sf_dir)))


def gr31_threshold_sweep(spark, sf_dir):
    """Links and their agreement with the duplicate groups at several thresholds, from one scoring."""
    dup = _t(spark, sf_dir, "dupmembers").distinct()
    scores = S.pair_scores(_features(_grouped(spark, sf_dir)))
    side = lambda s: dup.select(F.col("refid").alias(s), F.col("duplicateid").alias(f"d{s}"))
    both = scores.join(side("a"), "a").join(side("b"), "b").withColumn("score", F.round("score", 6))
    at = F.explode(F.array(*[F.lit(x) for x in (0.05, 0.1, 0.3, 0.5)]))
    hits = both.withColumn("threshold", at).where("score > threshold")
    return hits.groupBy("threshold").agg(F.count("*").alias("links"), F.sum((F.col("da") == F.col("db")).cast("long")).alias("right"))


def _title_words(spark, sf_dir) -> DataFrame:
    """(rec, f): words of every distinct title, under its smallest row."""
    titles = _t(spark, sf_dir, "refmetas").where("title is not null").groupBy("title").agg(F.min("refid").alias("rec"))
    return titles.select("rec", F.explode(F.array_distinct(T.words(F.col("title")))).alias("f"))


def sc20_simhash(spark, sf_dir):
    return S.simhash(_title_words(spark, sf_dir))


def jn10_hamming_pairs(spark, sf_dir):
    return S.hamming_pairs(cut(S.simhash(_title_words(spark, sf_dir))), 7)


def gr15_simhash_blocks(spark, sf_dir):
    prints = cut(S.simhash(_title_words(spark, sf_dir)))
    alone = prints.select(F.col("rec").alias("a"), F.col("rec").alias("b"))
    # Components read their edges twice; the pairs are looked for once.
    near = cut(S.hamming_pairs(prints, 7).select("a", "b"))
    return G.components(near.union(alone)).withColumnRenamed("node", "rec").withColumnRenamed("component", "block")


# --- consolidation ---


def _members(spark, sf_dir) -> DataFrame:
    trust = _t(spark, sf_dir, "pipelines").select(F.col("pipeline").alias("frompipeline"), F.col("trust").cast("double").alias("weight"))
    return _t(spark, sf_dir, "dupmembers").distinct().withColumnRenamed("duplicateid", "grp").join(_t(spark, sf_dir, "refmetas"), "refid").join(trust, "frompipeline", "left")


def _valued(members: DataFrame, field: str) -> DataFrame:
    return members.select("grp", F.col("refid").alias("id"), F.col(field).alias("value"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


def ag13_top_terms(spark, sf_dir):
    return C.top_terms(_valued(_members(spark, sf_dir), "title"), 3.0).select("grp", "gram", F.round("score", 6).alias("score"))


def ag14_best_representative(spark, sf_dir):
    return C.best_representative(_valued(_members(spark, sf_dir), "title"), 3.0)


def ag15_majority_vote(spark, sf_dir):
    return C.majority_vote(_members(spark, sf_dir), ["volume", "issue", "year"], "refid")


def ag16_majority_name(spark, sf_dir):
    return C.majority_name(_members(spark, sf_dir), ["a1sur", "a1init", "a1first"], "refid")


def ag17_best_target(spark, sf_dir):
    m = _members(spark, sf_dir)
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("value")) for t in TARGETS]))
    return C.best_target(m.select("grp", pairs.alias("p")).select("grp", "p.target", "p.value"), list(TARGETS))


def ag18_group_facts(spark, sf_dir):
    """Counts and distinct values of every group."""
    m = _members(spark, sf_dir)
    return m.groupBy("grp").agg(F.count("*").alias("num_references"), F.countDistinct("frompipeline").alias("num_pipelines"), F.countDistinct("linkid").alias("num_links"), F.max(F.col("crossrefid").isNotNull()).alias("has_crossref"), F.countDistinct("year").alias("num_years"))


def prj15_write_back(spark, sf_dir):
    """Rows with their group's majority year and volume, their own kept beside."""
    refs = _t(spark, sf_dir, "refmetas").select("refid", "year", "volume")
    won = C.majority_vote(_members(spark, sf_dir), ["year", "volume"], "refid")
    canonical = won.join(_t(spark, sf_dir, "dupmembers").distinct().withColumnRenamed("duplicateid", "grp"), "grp").select("refid", "year", "volume")
    return C.write_back(refs, canonical, "refid", ["year", "volume"])


def prj16_reset(spark, sf_dir):
    return C.reset(prj15_write_back(spark, sf_dir), ["year", "volume"])


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[:2] in ("jn", "st", "wn", "ag", "gr", "sc", "pr") and n[2:3].isdigit() | n.startswith("prj1")}

# --- the same in SQL ---------------------------------------------------------------------------------------------------------

_EV = "(select distinct mentionid as mention, goldid as gold, label, nullif(lower(trim(repid, ' ')), '') as rep from mentions)"
_REPF = f"""
    reps as (select distinct {_sql_fold("lower(a1sur)")} as a, cast(year as varchar) as y, lower(source) as s from refmetas),
    tags as (select [x for x in ['a:' || a, 'y:' || y, 's:' || s] if x is not null] as fs from reps),
    feats as materialized (select distinct sha1(array_to_string(fs, '|')) as rep, unnest(fs) as f from tags),
    sizes as (select rep, count(*) as n from feats group by rep),
    meets as (select x.rep as sub, y.rep as sup, count(*) as k from feats x join feats y on x.f = y.f and x.rep <> y.rep group by 1, 2),
    cont as materialized (select sub, sup, a.n as small, b.n as large from meets join sizes a on sub = a.rep join sizes b on sup = b.rep where k = a.n and a.n < b.n)
"""
_MEMB = "memb as (select d.duplicateid as grp, r.*, coalesce(cast(trust as double), 1.0) as weight from (select distinct * from dupmembers) d join refmetas r using (refid) left join pipelines p on p.pipeline = r.frompipeline)"


def _sql_features() -> str:
    grams = lambda ftype, field: f"select grp, refid as rec, '{ftype}' as ftype, '{field}=' || unnest({_sql_ngrams(field, 3)}) as value from g"
    plain = lambda ftype, field: f"select grp, refid, '{ftype}', '{field}=' || coalesce(cast({field} as varchar), 'None') from g"
    parts = [grams("title", "title"), grams("source", "source"), *[plain("pubnumber", c) for c in ("issue", "volume", "year")]]
    for i in range(1, 3):
        parts += [grams("surname", f"a{i}sur"), plain("init", f"a{i}init"), grams("first", f"a{i}first")]
    parts += [grams("editor", "e1sur"), grams("publisher", "publisher1")]
    return f"""g as (select r.*, m.grp from refmetas r join (select distinct refid, regexp_extract(duplicateid, '^([^_]*)_', 1) as grp from dupmembers) m using (refid)),
        f as materialized (select distinct * from ({" union all ".join(parts)})),
        n as (select grp, rec, ftype, count(*) as n from f group by all),
        i as (select x.grp, x.rec as a, y.rec as b, x.ftype, count(*) as i from f x join f y on x.grp = y.grp and x.ftype = y.ftype and x.value = y.value and x.rec < y.rec group by all),
        s as materialized (select i.grp, a, b, i.ftype, i.i, u.n as na, v.n as nb from i join n u on u.grp = i.grp and u.rec = a and u.ftype = i.ftype join n v on v.grp = i.grp and v.rec = b and v.ftype = i.ftype)"""


_SCORE = "1 / (1 + exp(-(sum(i / (na + nb - i) * case ftype " + " ".join(f"when '{k}' then {v}" for k, v in S.WEIGHTS.items()) + f" end) + {S.BIAS})))"
_CC = """links as materialized (select a as x, b as y from {edges} union select b, a from {edges}),
    walk as (select x as node, x as seen from links union select w.node, l.y from walk w join links l on w.seen = l.x)
    select node{names[0]}, min(seen){names[1]} from walk group by node"""


def _sql_components(edges: str, node: str = "node", component: str = "component") -> str:
    return _CC.format(edges=edges, names=(f" as {node}", f" as {component}"))


def _sql_hash_bits() -> str:
    hexa = lambda k: f"(instr('0123456789abcdef', substr(h, {k}, 1)) - 1)"
    out = []
    for byte in range(8):
        value = f"({hexa(2 * byte + 1)} * 16 + {hexa(2 * byte + 2)})"
        out.append("cast(" + " + ".join(f"case when avg(({value} >> {bit}) & 1) >= 0.5 then {1 << bit} else 0 end" for bit in range(8)) + f" as integer) as b{byte}")
    return ", ".join(out)


_WORDSQL = "regexp_extract_all(lower(title), '" + T.WORD + "')"
_PRINTS = f"""t as (select title, min(refid) as rec from refmetas where title is not null group by title),
    w as (select distinct rec, unnest({_WORDSQL}) as f from t), p as materialized (select rec, {_sql_hash_bits()} from (select rec, md5(f) as h from w) group by rec)"""
_DIST = " + ".join(f"bit_count(xor(x.b{i}, y.b{i}))" for i in range(8))
_HAM = f"h as materialized (select x.rec as a, y.rec as b, {_DIST} as distance from p x join p y on x.rec < y.rec and {_DIST} <= 7)"


def _sql_vote(fields: list[str], fits: str, order: str = "refid") -> str:
    names = ", ".join(fields)
    return f"""v as (select grp, {names}, count(*) as freq, min({order}) as seen from memb group by all),
        u as (select a.grp, {", ".join("a." + f for f in fields)}, a.seen, sum(b.freq) as support from v a join v b on a.grp = b.grp and {fits} group by all),
        won as (select grp, {names}, support from u qualify row_number() over (partition by grp order by support desc, seen) = 1)"""


_NULLFIT = lambda fields: " and ".join(f"(b.{f} is null or a.{f} is not distinct from b.{f})" for f in fields)
_NAMEFIT = lambda fields: " and ".join(f"(a.{f} is null or b.{f} is null or lower(a.{f}) = lower(b.{f}))" for f in fields)
_SQ = lambda df, g, a: f"(select coalesce(sum(n * n), 0) from (select count(*) as n from {df} where {g} is not null and {a} is not null group by {{}}))"
_TPT = lambda df, g, a: f"{_SQ(df, g, a).format(g)} as t, {_SQ(df, g, a).format(a)} as p, {_SQ(df, g, a).format(g + ', ' + a)} as tp"
_GRAMS = f"""val as (select grp, refid as id, title as value, weight from memb where title is not null and title <> ''),
    cnt as (select grp, count(*) as n from val group by grp),
    grm as materialized (select grp, id, weight, unnest(list_distinct({_sql_ngrams("value", 3)})) as gram from val),
    top as materialized (select g.grp, gram, sum(weight) / any_value(n) as score from grm g join cnt using (grp) group by g.grp, gram having sum(weight) > 0 and sum(weight) / any_value(n) > 3.0)"""
_GROUP_SIZES = lambda t, k: f"select {k}, count(*) as size from {t} where {k} is not null group by {k}"

SQL = {
    "jn1_label_lookup": "select r.refid, m.label from refmetas r left join (select distinct originalid, label from mentions) m on m.originalid = r.linkid",
    "jn2_canonical_lookup": "select r.refid, d.duplicateid from refmetas r left join (select distinct * from dupmembers) d using (refid)",
    "jn3_chain": "with m as (select distinct lower(trim(repid, ' ')) as repid, originalid, label from mentions where repid is not null) select m.label, count(distinct repid) as reps, count(distinct frompipeline) as pipelines, count(*) as n from m join (select distinct label from components where label is not null) c using (label) join refmetas r on r.linkid = m.originalid group by m.label",
    "jn4_target_types": "select pipeline, trust, count(*) as n, count(crossrefid) as with_crossref from refmetas join pipelines on frompipeline = pipeline group by 1, 2",
    "jn12_semi": "select refid from refmetas where refid in (select refid from dupmembers)",
    "jn13_not_in": "select 'filled' as list, label from (select distinct label from mentions where label not in (select label from components where label is not null)) union all select 'with null', label from (select distinct label from mentions where label not in (select label from components))",
    "jn14_anti": "select distinct originalid as linkid from mentions m where not exists (select 1 from refmetas r where r.linkid = m.originalid)",
    "st1_union": "select label from components union select label from mentions",
    "st3_except_intersect": "(select label from components except select label from mentions where goldid is not null) intersect select label from mentions where runno = 1",
    "wn1_first_wins": "select linkid, refid from refmetas qualify row_number() over (partition by linkid order by loaded_at, refid) = 1",
    "wn2_dense_index": "select distinct source, dense_rank() over (order by source) as sourceindex from refmetas where source is not null",
    "wn6_top_labels": "select label, count(*) as freq from mentions where label is not null group by label order by freq desc, label limit 20",
    "wn8_first_terms": f"select refid, w[1] as term1, w[2] as term2, w[3] as term3, w[4] as term4, w[5] as term5, w[6] as term6 from (select refid, {_WORDSQL} as w from refmetas)",
    "wn9_capped_samples": "select label, mentionid from (select distinct label, mentionid from mentions where label is not null) qualify row_number() over (partition by label order by mentionid) <= 10",
    "ag1_distinct_counts": "select source, count(*) as n from refmetas where source is not null group by source",
    "ag3_pair_prf": f"with c as (select {_TPT(_EV, 'gold', 'label')}), x as (select 100.0 * tp / nullif(p, 0) as p, 100.0 * tp / nullif(t, 0) as r from c) select round_even(p, 0) as precision, round_even(r, 0) as recall, round_even(2 * p * r / (p + r), 0) as f1 from x",
    "ag4_group_sizes": f"with s as ({_GROUP_SIZES('mentions', 'label')}), o as (select size, row_number() over (order by size) as k, count(*) over () as n from s) select max(case when k = n // 2 + 1 then size end) as median_size, round(sum(size) / count(*), 6) as avg_size from o",
    "ag5_capped_evaluation": f"""with ev as {_EV}, ok as (select * from ev where gold is not null and label is not null and rep is not null),
        big as (select label from components where label is not null group by label having count(distinct repidindex) > {MAX_LABEL}),
        kept as (select gold from ok group by gold having count(*) <= {MAX_GOLD}),
        a as (select gold, case when label in (select label from big) then 'r' || rep else 'l' || label end as auto from ok where gold in (select gold from kept)),
        c as (select {_TPT('a', 'gold', 'auto')}) select t, p, tp, floor(10000 * tp / nullif(p, 0)) / 100 as precision, floor(10000 * tp / nullif(t, 0)) / 100 as recall from c""",
    "ag6_distinct_evaluation": f"""with r as (select distinct mention, gold, label from {_EV} where gold is not null and label is not null),
        big as (select label from r group by label having count(distinct mention) > {MAX_LABEL}),
        a as (select gold, case when label in (select label from big) then 'm' || mention else 'l' || label end as auto from r) select {_TPT('a', 'gold', 'auto')}""",
    "ag7_size_stats": "select max(freq) as largest, round(sum(freq) / count(*), 6) as average from (select count(*) as freq from mentions where label is not null group by label)",
    "ag8_core_evaluation": f"""with r as (select distinct mention, gold, label from {_EV} where gold is not null and label is not null),
        m as (select *, count(*) over (partition by gold, label) as gl, count(*) over (partition by gold) as g, count(*) over (partition by label) as l from r)
        select count(*) filter (l > 1 and gl = g) as tp, count(*) filter (l > 1 and gl < g) as fp, count(*) filter (l = 1 and g = 1) as tn, count(*) filter (l = 1 and g > 1) as fn from m""",
    "ag9_size_boundaries": f"with s as ({_GROUP_SIZES('components', 'label')}), h as (select size, count(*) as groups from s group by size) select size, groups, cast(sum(groups) over (order by size) as bigint) as up_to from h",
    "ag19_ratios": f"with c as (select {_TPT(_EV, 'gold', 'rep')}) select case when p = 0 or t = 0 then 1.0 else round(tp / p, 6) end as precision, case when p = 0 or t = 0 then 1.0 else round(tp / t, 6) end as recall, case when p = 0 or t = 0 then 1.0 else round(2 * (tp / p) * (tp / t) / (tp / p + tp / t), 6) end as f1 from c",
    "ag20_gini": f"with s as ({_GROUP_SIZES('components', 'label')}), o as (select size, row_number() over (order by size) as k, count(*) over () as n from s) select round(2 * sum(k * size) / (any_value(n) * sum(size)) - (any_value(n) + 1) / any_value(n), 6) as gini from o",
    "ag23_document_flags": "with r as (select distinct linkid, regexp_extract(linkid, '_(doc[0-9]+)_ref_', 1) as doc from refmetas), m as (select distinct originalid, label from mentions where label is not null) select doc, count(distinct label) as num_labels, count(distinct label) > 0 as has_labels from r left join m on originalid = linkid where doc <> '' group by doc",
    "ag24_merged_references": "select regexp_extract(linkid, '_(doc[0-9]+)_ref_([0-9]+)$', 1) as doc, duplicateid, min(try_cast(regexp_extract(linkid, '_(doc[0-9]+)_ref_([0-9]+)$', 2) as integer)) as first_pos from refmetas join (select distinct * from dupmembers) using (refid) where regexp_extract(linkid, '_(doc[0-9]+)_ref_([0-9]+)$', 1) <> '' group by 1, 2",
    "jn7_containment": f"with {_REPF} select sub, sup, small, large from cont",
    "gr13_poset_blocks": f"with recursive {_REPF}, mp as materialized (select sub, sup from cont where sub not in (select sup from cont)), ed as materialized (select sub as x, sup as y from mp union select sup, sub from mp), cc(node, comp) using key (node) as (select rep, rep from sizes union (select distinct on (u.node) u.node, v.comp from recurring.cc as u, ed, cc as v where ed.x = u.node and ed.y = v.node and v.comp < u.comp order by u.node, v.comp)) select node as rep, comp as block from cc",
    "gr19_minimal": f"with {_REPF} select rep from sizes where rep not in (select sup from cont)",
    "gr18_hasse": f"with {_REPF} select sub, sup from cont c where not exists (select 1 from cont x join cont y on x.sup = y.sub where x.sub = c.sub and y.sup = c.sup)",
    "gr20_observed_carried": f"with {_REPF} select rep, n as obs, n + coalesce((select sum(b.n) from cont join sizes b on b.rep = sup where sub = s.rep), 0) as car from sizes s",
    "ag10_minimal_multiplicity": f"with {_REPF}, per as (select sup, count(*) as minels from cont where sub not in (select sup from cont) group by sup) select minels, count(*) as n_sets from per group by 1",
    "gr14_single_feature_blocks": f"with {_REPF} select f, count(distinct rep) as reps from feats group by f",
    "gr6_components": "with recursive edges as (select repidindex_a as a, repidindex_b as b from repmatches where verdict = 1 and repidindex_a is not null and repidindex_b is not null), " + _sql_components("edges"),
    "gr10_gold_components": "with recursive ids as (" + " union all ".join(f"select refid, '{t}:' || {t} as target from refmetas where {t} is not null" for t in TARGETS) + "), edges as (select refid as a, min(refid) over (partition by target) as b from ids), " + _sql_components("edges"),
    "gr16_apply_components": f"select distinct mention, coalesce(cast(label as varchar), 's_' || coalesce(rep, cast(mention as varchar))) as label from {_EV}",
    "gr26_heaviest_parent": "select repidindex_a as child, repidindex_b as parent, score as weight from repmatches where score is not null and repidindex_a <> repidindex_b qualify row_number() over (partition by repidindex_a order by score desc, repidindex_b) = 1",
    "gr2_type_similarities": f"with {_sql_features()} select a, b, ftype, round(i / (na + nb - i), 6) as sim from s",
    "gr3_similarity_kinds": f"with {_sql_features()} select a, b, round(2 * i / (na + nb), 6) as dice, round(i / least(na, nb), 6) as overlap, round(i / sqrt(na * nb), 6) as cosine from s where ftype = 'title'",
    "gr5_pair_scores": f"with {_sql_features()} select a, b, round({_SCORE}, 6) as score from s group by grp, a, b",
    "gr5_logistic_clusters": f"with recursive {_sql_features()}, edges as materialized (select a, b from (select a, b, {_SCORE} as score from s group by grp, a, b) where score > {S.THRESHOLD} union select rec, rec from f), " + _sql_components("edges", "rec", "cluster"),
    "gr31_threshold_sweep": f"with {_sql_features()}, sc as (select a, b, round({_SCORE}, 6) as score from s group by grp, a, b), d as (select distinct * from dupmembers), x as (select score, u.duplicateid = v.duplicateid as same from sc join d u on u.refid = a join d v on v.refid = b) select threshold, count(*) as links, count(*) filter (same) as \"right\" from x, (select unnest([0.05, 0.1, 0.3, 0.5]::double[]) as threshold) where score > threshold group by threshold",
    "sc20_simhash": f"with {_PRINTS} select * from p",
    "jn10_hamming_pairs": f"with {_PRINTS}, {_HAM}, q as (select *, min(rec) over (partition by b0, b1, b2, b3, b4, b5, b6, b7) as rep from p), ap as (select a, b, distance from h join q x on x.rec = a join q y on y.rec = b where x.rep = a and y.rep = b) select * from ap union all select rep, rec, 0 from q where rep < rec",
    "gr15_simhash_blocks": f"with recursive {_PRINTS}, {_HAM}, edges as materialized (select a, b from h union select rec, rec from p), " + _sql_components("edges", "rec", "block"),
    "ag13_top_terms": f"with {_MEMB}, {_GRAMS} select grp, gram, round(score, 6) as score from top",
    "ag14_best_representative": f"""with {_MEMB}, {_GRAMS}, nt as (select grp, count(*) as nt from top group by grp), own as (select grp, id, count(*) as no from grm group by 1, 2),
        sh as (select g.grp, g.id, count(*) as i from grm g join top using (grp, gram) group by 1, 2)
        select sh.grp, sh.id from sh join own on own.grp = sh.grp and own.id = sh.id join nt on nt.grp = sh.grp qualify row_number() over (partition by sh.grp order by round(i / (no + nt - i), 9) desc, sh.id) = 1""",
    "ag15_majority_vote": f"with {_MEMB}, {_sql_vote(['volume', 'issue', 'year'], _NULLFIT(['volume', 'issue', 'year']))} select * from won",
    "ag16_majority_name": f"with {_MEMB}, {_sql_vote(['a1sur', 'a1init', 'a1first'], _NAMEFIT(['a1sur', 'a1init', 'a1first']))} select * from won",
    "ag17_best_target": f"with {_MEMB}, x as (" + " union all ".join(f"select grp, {i} as pr, '{t}' as target, {t} as value from memb where {t} is not null" for i, t in enumerate(TARGETS)) + "), c as (select grp, pr, target, value, count(*) as n from x group by all) select grp, target, value from c qualify row_number() over (partition by grp order by pr, n desc, value desc) = 1",
    "ag18_group_facts": f"with {_MEMB} select grp, count(*) as num_references, count(distinct frompipeline) as num_pipelines, count(distinct linkid) as num_links, bool_or(crossrefid is not null) as has_crossref, count(distinct year) as num_years from memb group by grp",
    "prj15_write_back": f"with {_MEMB}, {_sql_vote(['year', 'volume'], _NULLFIT(['year', 'volume']))} select r.refid, coalesce(w.year, r.year) as year, coalesce(w.volume, r.volume) as volume, r.year as year_original, r.volume as volume_original from refmetas r left join (select distinct * from dupmembers) d using (refid) left join won w on w.grp = d.duplicateid",
    "prj16_reset": "select refid, year, volume from refmetas",
}
