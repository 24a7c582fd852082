"""Queries of the classifier, vocabulary, lattice, training, sink and incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.functions import text as T
from refweave.operators import classify as K
from refweave.operators import graph as G
from refweave.operators import language as L
from refweave.operators import lattice as A
from refweave.operators import train as M
from refweave.plans.linkage import _REPF, _grouped, _hashed_features, _rep_features, _sql_features, _sql_ngrams
from refweave.sources import files as S
from refweave.sources.tables import cut, table
from refweave.streaming.incremental import label_batch

LANGUAGES = {"de": ["der", "die", "und", "zur", "nach", "eine"], "en": ["the", "of", "and", "in", "evidence"], "fr": ["la", "de", "et", "sur", "une"], "ru": ["и", "в", "как", "года"]}
RULES = "1 a 1 s 1 y --> 1 a 1 y | 1 a 1 s | 1 s 1 y\n1 a 1 y --> 1 a\n1 s 1 y --> 1 s"
NCHAR, FREQUENT = 3, 20


def _block_pairs(spark, sf_dir) -> DataFrame:
    """Pairs of rows of one cluster with what the classifier compares."""
    cluster = table(spark, sf_dir, "dupmembers").select("refid", T.strip_last_part(F.col("duplicateid")).alias("grp")).distinct()
    rows = table(spark, sf_dir, "refmetas").join(cluster, "refid")
    # Parts of names, pooled over all authors: the assignment is between parts.
    names = F.flatten(F.transform(F.array_compact(F.array(*[F.col(f"a{i}sur") for i in range(1, 5)])), lambda n: F.split(n, r"[^\p{L}\p{N}_]+")))
    kept = cut(rows.select("grp", "refid", "crossrefid", "openalexid", "title", "year", "a1sur", K.fields(rows, {"title": [F.col("title")], "year": [F.col("year")], "authors": names, "source": [F.col("source")], "volume": [F.col("volume")], "issue": [F.col("issue")]}).alias("f")))
    x, y = kept.alias("x"), kept.alias("y")
    return x.join(y, (F.col("x.grp") == F.col("y.grp")) & (F.col("x.refid") < F.col("y.refid")))


def _candidates(spark, sf_dir) -> DataFrame:
    same = F.coalesce(F.col("x.crossrefid") == F.col("y.crossrefid"), F.lit(False)) | F.coalesce(F.col("x.openalexid") == F.col("y.openalexid"), F.lit(False))
    return _block_pairs(spark, sf_dir).select(F.col("x.refid").alias("a"), F.col("y.refid").alias("b"), same.alias("same_id"), F.col("x.f").alias("left"), F.col("y.f").alias("right"))


def gr7_pair_classifier(spark, sf_dir):
    return K.classified(_candidates(spark, sf_dir))


def gr8_duplicates(spark, sf_dir):
    members = table(spark, sf_dir, "dupmembers").select(F.col("refid").alias("rec")).distinct()
    return K.duplicates(members, _candidates(spark, sf_dir))


def gr9_simple_rule(spark, sf_dir):
    rule = K.simple_rule(F.col("x.title"), F.col("y.title"), F.col("x.year"), F.col("y.year"), F.col("x.a1sur"), F.col("y.a1sur"))
    return _block_pairs(spark, sf_dir).where(rule).select(F.col("x.refid").alias("a"), F.col("y.refid").alias("b"))


def sc22_title_difference(spark, sf_dir):
    """Differences of the rows' titles and printed references."""
    return table(spark, sf_dir, "refmetas").select("refid", F.round(K.title_difference("title", "refstring"), 6).alias("difference"))


def ag22_whitespace_counts(spark, sf_dir):
    return L.context_counts(table(spark, sf_dir, "refmetas"), "refstring", NCHAR)


def sc34_merge_scores(spark, sf_dir):
    scores = L.merge_scores(L.context_counts(table(spark, sf_dir, "refmetas"), "refstring", NCHAR))
    return scores.select("h", "w", F.round("score", 5).alias("score"))


def _vocabulary(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Title words, and those frequent enough to be the vocabulary."""
    words = table(spark, sf_dir, "refmetas").select(F.explode(T.words(F.col("title"))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    words = cut(words)
    return words.where(f"freq < {FREQUENT}").select("word"), words.where(f"freq >= {FREQUENT}").withColumnRenamed("word", "term")


def sc8_corrections(spark, sf_dir):
    return L.corrected(*_vocabulary(spark, sf_dir))


def sc9_known_words(spark, sf_dir):
    rare, known = _vocabulary(spark, sf_dir)
    both = rare.union(known.select("term")).join(known.select(F.col("term").alias("word"), F.lit(True).alias("k")), "word", "left")
    return both.where("length(word) > 2").select("word", F.coalesce("k", F.lit(False)).alias("is_word"))


def sc10_language_votes(spark, sf_dir):
    return table(spark, sf_dir, "refmetas").select("refid", L.language_votes(F.col("title"), LANGUAGES).alias("language"))


def sc11_compounds(spark, sf_dir):
    rare, known = _vocabulary(spark, sf_dir)
    return L.compounds(rare.union(known.select("term")), known).select("word", F.array_join("parts", " ").alias("parts"))


def _bundles(spark, sf_dir) -> DataFrame:
    f = _rep_features(spark, sf_dir)
    of = lambda t: F.array_sort(F.collect_set(F.when(F.col("f").startswith(f"{t}:"), F.col("f"))))
    return f.groupBy("rep").agg(*[of(t).alias(t) for t in "asy"])


def gr11_generalize(spark, sf_dir):
    """General forms of all bundles, each once, with how many bundles they stand above."""
    general = A.generalized(_bundles(spark, sf_dir), A.parse_rules(RULES), ["a", "s", "y"])
    shown = F.array_join(F.concat(*[F.coalesce(t, F.array().cast("array<string>")) for t in ("a", "s", "y")]), "|")
    return general.groupBy(shown.alias("form")).agg(F.countDistinct("rep").alias("reps"))


def gr17_levels(spark, sf_dir):
    features = cut(_rep_features(spark, sf_dir))
    return G.levels(cut(G.contained(features).select("sub", "sup")))


def gr17_reduction(spark, sf_dir):
    features = cut(_rep_features(spark, sf_dir))
    return G.reduction(cut(G.contained(features).select("sub", "sup")))


def gr22_agglomerated(spark, sf_dir):
    """Sets merged along the covers of their lattice; how many each representative stands for."""
    features = cut(_rep_features(spark, sf_dir))
    nodes = features.groupBy("rep").agg(F.lit(1.0).alias("obs"), F.count("*").alias("size"))
    return A.agglomerated(nodes, G.hasse(cut(G.contained(features)))).groupBy("merged").agg(F.count("*").alias("n"))


def gr25_generalization_levels(spark, sf_dir):
    features = cut(_rep_features(spark, sf_dir))
    covers = cut(G.hasse(cut(G.contained(features))))
    starts = features.select(F.col("rep").alias("start"), "rep").distinct()
    return A.level_of_generalization(covers, starts)


def prj19_licensed(spark, sf_dir):
    """Rows whose set of filled feature types has two or more, with a title wherever a source is."""
    types = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in ("title", "source", "a1sur", "year")]))
    return table(spark, sf_dir, "refmetas").where(A.licensed(types, {"source": ["title"]}, {})).select("refid")


def gr30_training_vectors(spark, sf_dir):
    groups = table(spark, sf_dir, "dupmembers").select(F.col("refid").alias("rec"), F.col("duplicateid").alias("group")).distinct()
    v = M.vectors(_hashed_features(_grouped(spark, sf_dir)), groups)
    return v.select("a", "b", *[F.round(t, 6).alias(t) for t in M.TYPES], "label")


def gr30_coefficients(spark, sf_dir):
    groups = table(spark, sf_dir, "dupmembers").select(F.col("refid").alias("rec"), F.col("duplicateid").alias("group")).distinct()
    return M.coefficients(M.vectors(_hashed_features(_grouped(spark, sf_dir)), groups))


def snk4_upsert(spark, sf_dir):
    """Frequencies of representations of two runs, added up."""
    m = table(spark, sf_dir, "mentions").where("repid is not null").select(F.lower(F.trim("repid")).alias("repid"), "freq", "runno")
    one = lambda run: m.where(F.col("runno") == run).groupBy("repid").agg(F.sum("freq").alias("freq"))
    return S.upsert(one(1), one(2), "repid", "freq")


def snk6_dot(spark, sf_dir):
    return S.dot_lines(table(spark, sf_dir, "repmatches").where("verdict = 1 and repidindex_a is not null and repidindex_b is not null"), "repidindex_a", "repidindex_b").distinct()


def snk7_edge_properties(spark, sf_dir):
    m = table(spark, sf_dir, "repmatches").where("repidindex_a is not null and repidindex_b is not null").groupBy("repidindex_a", "repidindex_b").agg(F.max(F.round(F.col("score") * 1e6).cast("long")).alias("score_in_millionths"), F.count("*").alias("n"))
    nodes = m.select(F.col("repidindex_a").alias("node")).distinct().withColumn("kind", F.lit("representation"))
    _, props, _ = S.property_graph(nodes, m, "node", "repidindex_a", "repidindex_b")
    return props


def incremental_labels(spark, sf_dir):
    """The last run's mentions labelled by what the runs before know."""
    m = table(spark, sf_dir, "mentions").where("repid is not null").select("mentionid", F.lower(F.trim("repid")).alias("repid"), "label", "runno")
    known = m.where("runno < 3 and label is not null").groupBy("repid").agg(F.min("label").cast("string").alias("label"))
    return label_batch(m.where("runno = 3").groupBy("mentionid").agg(F.min("repid").alias("repid")), known)


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

_WORDS = "with w as (select w as word, count(*) as freq from (select unnest(regexp_extract_all(lower(title), '" + T.WORD + f"')) as w from refmetas) group by w), rare as (select word from w where freq < {FREQUENT}), known as (select word as term, freq from w where freq >= {FREQUENT})"
_CTX = f"""t as (select list_filter(regexp_split_to_array(lower(refstring), '\\s+'), lambda x: length(x) > 0) as ws from refmetas where refstring is not null),
    b as (select unnest(list_transform(range(1, len(ws)), lambda i: [right(ws[i], {NCHAR}), left(ws[i + 1], {NCHAR})])) as c, true as across from t),
    s as (select unnest(ws) as x from t),
    i as (select unnest(list_transform(range(1, length(x)), lambda i: [right(left(x, i), {NCHAR}), left(substr(x, i + 1), {NCHAR})])) as c, false as across from s),
    cnt as materialized (select across, c[1] as h, c[2] as w, count(*) as n from (select * from b union all select * from i) group by all)"""
_PAIRS = "memb as (select distinct refid, regexp_replace(duplicateid, '_[^_]*$', '') as grp from dupmembers), m as (select r.*, grp from refmetas r join memb using (refid))"


def _overlap(c: str) -> str:
    gx, gy = (f"list_distinct({_sql_ngrams(f'{s}.{c}', 3)})" for s in "xy")
    return f"len(list_intersect({gx}, {gy})) / nullif(least(len({gx}), len({gy})), 0)"


_VOTES = {c: "len([w for w in regexp_split_to_array(lower(title), '[^\\p{L}]+') if w in (" + ", ".join(f"'{x}'" for x in s) + ")])" for c, s in sorted(LANGUAGES.items())}

_HASSE = "has as materialized (select sub, sup from cont c where not exists (select 1 from cont x join cont y on x.sup = y.sub where x.sub = c.sub and y.sup = c.sup))"
_TYPE = lambda t: f"max(f) filter (f like '{t}:%') as {t}"

SQL = {
    "gr17_levels": f"with recursive {_REPF}, w as (select rep as node, 0 as level from sizes where rep in (select sub from cont union select sup from cont) union select sup, level + 1 from w join cont on sub = node) select node, max(level) as level from w group by node",
    "gr25_generalization_levels": f"with recursive {_REPF}, {_HASSE}, w as (select rep as start, rep, 0 as level from sizes union select start, sub, level + 1 from w join has on sup = rep) select start, rep, min(level) as level from w group by start, rep",
    "gr11_generalize": f"with {_REPF}, r as (select rep, {_TYPE('a')}, {_TYPE('s')}, {_TYPE('y')} from feats group by rep), g as (select rep, a || '|' || y as form from r where s is not null union all select rep, a || '|' || s from r where y is not null union all select rep, s || '|' || y from r where a is not null union all select rep, a from r where s is null and y is not null union all select rep, s from r where a is null and y is not null) select form, count(distinct rep) as reps from g where form is not null group by form",
    "gr30_training_vectors": f"with {_sql_features()}, v as (select a, b, " + ", ".join(f"round(coalesce(max(case when ftype = '{t}' then i / (na + nb - i) end), 0), 6) as {t}" for t in M.TYPES) + " from s group by a, b), d as (select distinct refid, duplicateid from dupmembers) select v.*, cast(x.duplicateid = y.duplicateid as double) as label from v join d x on x.refid = a join d y on y.refid = b",
    "snk7_edge_properties": "with m as (select repidindex_a as a, repidindex_b as b, max(cast(round(score * 1e6) as bigint)) as s, count(*) as n from repmatches where repidindex_a is not null and repidindex_b is not null group by 1, 2), e as (select sha1(a || '|' || b) as edge, s, n from m) select edge, 'score_in_millionths' as prop, cast(s as varchar) as value, 'bigint' as type from e where s is not null union all select edge, 'n', cast(n as varchar), 'bigint' from e",
    "gr9_simple_rule": f"with {_PAIRS} select x.refid as a, y.refid as b from m x join m y on x.grp = y.grp and x.refid < y.refid where coalesce(abs(x.year - y.year) <= 1, true) and coalesce({_overlap('title')} >= 0.75, false) and coalesce({_overlap('a1sur')} >= 0.5, true)",
    "ag22_whitespace_counts": f"with {_CTX} select across, h, w, n from cnt",
    "sc34_merge_scores": f"""with {_CTX}, hh as (select across, h, sum(n) as f, count(*) as d from cnt group by all), ww as (select across, w, count(*) as d from cnt group by all), aa as (select across, count(*) as k from cnt group by all),
        p as (select across, h, w, greatest(0, n - {L.DELTA}) / hh.f + {L.DELTA} / hh.f * hh.d * ww.d / k as p from cnt join hh using (across, h) join ww using (across, w) join aa using (across))
        select x.h, x.w, round(x.p / y.p, 5) as score from p x join p y on x.h = y.h and x.w = y.w where not x.across and y.across""",
    "sc8_corrections": _WORDS + ", l as (select word, term, freq, levenshtein(translate(word, 'äöüß', '1234'), translate(term, 'äöüß', '1234')) as d from rare, known where abs(length(word) - length(term)) <= 2), c as (select * from l where d <= least(2, floor(length(word) * 0.2)) and floor(length(word) * 0.2) >= 1), b as (select word, term from c qualify row_number() over (partition by word order by d, freq desc, term) = 1) select rare.word, coalesce(term, rare.word) as correction from rare left join b using (word)",
    "sc9_known_words": _WORDS + f" select word, freq >= {FREQUENT} as is_word from w where length(word) > 2",
    "sc10_language_votes": "select refid, case when title is null then 'default' else coalesce((list_sort([x for x in [" + ", ".join(f"{{'n': {v}, 'code': '{c}'}}" for c, v in _VOTES.items()) + "] if x.n > 0], 'DESC'))[1].code, 'default') end as language from refmetas",
    "sc11_compounds": _WORDS.replace("with ", "with recursive ", 1) + ", s as (select word, []::varchar[] as parts, word as rest from w where length(word) >= 8 union select word, list_append(parts, head), unnest(list_distinct([next, case when left(next, 1) = 's' then substr(next, 2) else next end])) from (select word, parts, left(rest, i) as head, substr(rest, i + 1) as next from (select word, parts, rest, unnest(range(4, length(rest))) as i from s where parts = [] or rest not in (select term from known))) where head in (select term from known) and length(next) >= 3), d as (select word, list_append(parts, rest) as parts from s where parts <> [] and length(rest) >= 4 and rest in (select term from known)) select word, array_to_string(parts, ' ') as parts from d qualify row_number() over (partition by word order by length(parts[1]) desc, len(parts), parts desc) = 1",
    "gr17_reduction": f"with {_REPF} select sub, sup from cont c where not exists (select 1 from cont x join cont y on x.sup = y.sub where x.sub = c.sub and y.sup = c.sup)",
    "prj19_licensed": "select refid from refmetas where (title is not null)::int + (source is not null)::int + (a1sur is not null)::int + (year is not null)::int >= 2 and (source is null or title is not null)",
    "snk4_upsert": "select lower(trim(repid, ' ')) as repid, sum(freq) as freq from mentions where repid is not null and runno in (1, 2) group by 1",
    "snk6_dot": "select distinct '\"' || repidindex_a || '\" -> \"' || repidindex_b || '\";' as value from repmatches where verdict = 1 and repidindex_a is not null and repidindex_b is not null",
    "incremental_labels": "with m as (select mentionid, lower(trim(repid, ' ')) as repid, label, runno from mentions where repid is not null), k as (select repid, cast(min(label) as varchar) as label from m where runno < 3 and label is not null group by repid), b as (select mentionid, min(repid) as repid from m where runno = 3 group by mentionid) select mentionid, b.repid, coalesce(k.label, 's_' || b.repid) as label from b left join k using (repid)",
}
