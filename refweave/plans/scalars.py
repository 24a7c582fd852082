"""Queries of the scalar functions and row-wise projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.functions import text as T
from refweave.operators.similarity import BIAS, WEIGHTS
from refweave.sources.tables import table

NEXT_YEAR = 2027
SLOTS = {"surname": ("a1sur", "a2sur", "a3sur", "a4sur"), "init": ("a1init", "a2init", "a3init", "a4init"), "year": ("year",)}
TARGETS = ("sowiportid", "crossrefid", "dnbid", "openalexid", "econbizid", "arxivid", "ssoarid", "research_dataid", "gesis_bibid")


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "refmetas")


def _counted(df: DataFrame, items) -> DataFrame:
    return df.select(F.explode(items).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def sc1_ngrams(spark, sf_dir):
    return _counted(_refs(spark, sf_dir), T.ngrams(F.col("title"), 3))


def sc2_words(spark, sf_dir):
    return _counted(_refs(spark, sf_dir), T.words(F.col("title")))


def sc3_wordgrams(spark, sf_dir):
    return _counted(_refs(spark, sf_dir), T.wordgrams(F.col("title"), 2))


def sc5_ascii_fold(spark, sf_dir):
    return _refs(spark, sf_dir).select("refid", T.ascii_fold(F.col("a1sur")).alias("folded"))


def sc6_html_fold(spark, sf_dir):
    return _refs(spark, sf_dir).select("refid", T.html_fold(F.col("a1sur")).alias("folded"))


def sc7_tokens(spark, sf_dir):
    return _counted(_refs(spark, sf_dir), T.tokens(F.col("title")))


def sc12_char_ngrams(spark, sf_dir):
    return _counted(_refs(spark, sf_dir), T.char_ngrams(F.col("a1sur"), 3))


def sc14_author_grams(spark, sf_dir):
    """The first twelve padded n-grams of every normalised first author."""
    return _refs(spark, sf_dir).select("refid", F.array_join(F.slice(T.ngrams(T.author_norm(F.col("a1sur")), 3), 1, 12), " ").alias("grams"))


def sc15_year_pairs(spark, sf_dir):
    before, after = T.year_pairs(F.col("year"), NEXT_YEAR)
    return _refs(spark, sf_dir).select("refid", before.alias("year1"), after.alias("year2"))


def sc16_author_norm(spark, sf_dir):
    return _refs(spark, sf_dir).select("refid", T.author_norm(F.col("a1sur")).alias("name"))


def sc17_bundle(spark, sf_dir):
    refs = _refs(spark, sf_dir)
    own = T.bundle(*[F.col(c) for c in SLOTS["surname"]])
    return refs.select("refid", *[F.get(own, F.lit(i)).alias(f"s{i + 1}") for i in range(4)])


def _bundled(refs: DataFrame) -> DataFrame:
    values = []
    for cols in SLOTS.values():
        own = T.bundle(*[F.col(c) for c in cols])
        values += [F.get(own, F.lit(i)) for i in range(len(cols))]
    return refs.withColumn("repid", T.representation_id(values))


def sc18_representation_id(spark, sf_dir):
    return _bundled(_refs(spark, sf_dir)).select("refid", "repid")


def ag2_representations(spark, sf_dir):
    """Representations of all rows with their frequency, and the smallest row of each."""
    return _bundled(_refs(spark, sf_dir)).groupBy("repid").agg(F.count("*").alias("freq"), F.min("refid").alias("first_refid"))


def sc27_logistic(spark, sf_dir):
    return table(spark, sf_dir, "repmatches").select("matchid", F.round(T.logistic(F.lit(BIAS) + WEIGHTS["title"] * F.col("score")), 6).alias("p"))


def sc28_set_similarities(spark, sf_dir):
    """All set similarities of the word sets of the references' and the printed titles."""
    refs = _refs(spark, sf_dir)
    a, b = F.array_distinct(T.words(F.col("title"))), F.array_distinct(T.words(F.col("refstring")))
    sets = refs.select("refid", F.size(a).alias("na"), F.size(b).alias("nb"), F.size(F.array_intersect(a, b)).alias("both")).where("na > 0 and nb > 0")
    return sets.select("refid", *[F.round(T.similarity(k, F.col("both"), F.col("na"), F.col("nb")), 6).alias(k) for k in ("jaccard", "dice", "overlap", "cosine", "probability")])


def sc29_threshold_curve(spark, sf_dir):
    return table(spark, sf_dir, "repmatches").select("matchid", F.round(T.logistic_curve(F.col("score"), 1.0, 5.0, 0.1), 6).alias("threshold"))


def sc30_representation_text(spark, sf_dir):
    """A representation as sorted text, values in braces."""
    refs = _refs(spark, sf_dir)
    shown = lambda cols: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.col(c) for c in cols])))), ",")
    return refs.select("refid", F.concat(F.lit("init: {"), shown(SLOTS["init"]), F.lit("} surname: {"), shown(SLOTS["surname"]), F.lit("}")).alias("shown"))


def sc32_type_signature(spark, sf_dir):
    """How many values of each feature type a row has, and how many rows share that signature."""
    refs = _refs(spark, sf_dir)
    sizes = [F.size(F.array_distinct(F.array_compact(F.array(*[F.col(c) for c in cols])))).alias(f"n_{name}") for name, cols in SLOTS.items()]
    return refs.select(*sizes).groupBy("n_surname", "n_init", "n_year").agg(F.count("*").alias("n_rows"))


def sc33_identifiers(spark, sf_dir):
    """Link ids built anew: the target id of matched rows, else the given one."""
    refs = _refs(spark, sf_dir)
    built = F.lit(None).cast("string")
    for t in TARGETS:
        built = F.when(F.col("frompipeline") == f"matched_references_from_{t[:-2].rstrip('_')}", F.col(t)).otherwise(built)
    return refs.select("refid", F.coalesce(built, "linkid").alias("built"))


def src2_filtered_scan(spark, sf_dir):
    return _refs(spark, sf_dir).where("year between 1990 and 2010 and refstring is not null").select("refid", "year", "title")


def src3_term_scan(spark, sf_dir):
    return _refs(spark, sf_dir).where("frompipeline = 'matched_references_from_crossref'").select("refid", "title")


def prj2_typed_extraction(spark, sf_dir):
    """Years in bounds, titles with the printed reference as fallback."""
    refs = _refs(spark, sf_dir)
    return refs.select("refid", T.clean_int(F.col("year").cast("string"), 1500, NEXT_YEAR).alias("year"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), "refstring").alias("title"))


def prj3_author_slots(spark, sf_dir):
    """One row per author slot in use, initials and first names only beside a surname."""
    refs = _refs(spark, sf_dir)
    slot = lambda i: F.struct(F.lit(i).alias("pos"), F.col(f"a{i}sur").alias("sur"), F.when(F.col(f"a{i}sur").isNotNull(), F.col(f"a{i}init")).alias("init"), F.when(F.col(f"a{i}sur").isNotNull(), F.col(f"a{i}first")).alias("first"))
    return refs.select("refid", F.explode(F.array(*[slot(i) for i in range(1, 5)])).alias("a")).select("refid", "a.*").where("sur is not null")


def prj5_target_flags(spark, sf_dir):
    return _refs(spark, sf_dir).select("refid", *[F.col(t).isNotNull().alias(f"has_{t}") for t in TARGETS])


def prj8_drop_sentinels(spark, sf_dir):
    return _refs(spark, sf_dir).select("refid", F.when(~F.col("title").isin("None", " ", ""), F.col("title")).alias("title"))


def prj9_clean_int(spark, sf_dir):
    """Year, volume and issue within bounds; as start and end, volume and issue bound each other."""
    refs = _refs(spark, sf_dir)
    return refs.select(
        "refid", T.clean_int(F.col("year").cast("string"), 1500, NEXT_YEAR).alias("year"),
        T.clean_int(F.col("volume").cast("string"), 1, 1000).alias("volume"), T.clean_int(F.col("issue").cast("string"), 1, 1000).alias("issue"),
        T.clean_int(F.col("issue").cast("string"), F.lit(1), F.col("volume")).alias("start"),
        T.clean_int(F.col("volume").cast("string"), F.col("issue"), F.lit(10000)).alias("end"),
    )


def prj11_underspecified_fill(spark, sf_dir):
    """Rows without author or, failing that, without title and year get their own id there."""
    refs = _refs(spark, sf_dir)
    no_author = F.coalesce("a1sur", "e1sur").isNull()
    no_title = F.coalesce("title", F.col("year").cast("string")).isNull()
    return refs.select("refid", F.when(no_author, F.col("refid").cast("string")).otherwise(F.col("a1sur")).alias("a1sur"), F.when(~no_author & no_title, F.col("refid").cast("string")).otherwise(F.col("title")).alias("title"))


def prj13_any_feature(spark, sf_dir):
    return _refs(spark, sf_dir).where(F.coalesce(*[F.col(c) for c in ("a1sur", "title", "source")], F.col("year").cast("string")).isNotNull()).select("refid")


def prj14_document_blocks(spark, sf_dir):
    """Rows extracted from one document under one dense number."""
    docs = _refs(spark, sf_dir).select("refid", F.regexp_extract("linkid", "_(doc[0-9]+)_ref_", 1).alias("doc")).where("doc <> ''")
    # Documents are numbered by rank among the documents alone, then joined back: no task sorts all rows.
    from refweave.operators.relational import dense_numbers

    return docs.join(dense_numbers(docs.select("doc").distinct(), "doc", "block"), "doc").select("refid", "doc", "block")


def prj17_cluster_id(spark, sf_dir):
    return table(spark, sf_dir, "dupmembers").select("duplicateid", T.strip_last_part(F.col("duplicateid")).alias("clusterid")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        sc1_ngrams, sc2_words, sc3_wordgrams, sc5_ascii_fold, sc6_html_fold, sc7_tokens, sc12_char_ngrams, sc14_author_grams, sc15_year_pairs, sc16_author_norm, sc17_bundle, sc18_representation_id,
        ag2_representations, sc27_logistic, sc28_set_similarities, sc29_threshold_curve, sc30_representation_text, sc32_type_signature, sc33_identifiers, src2_filtered_scan, src3_term_scan,
        prj2_typed_extraction, prj3_author_slots, prj5_target_flags, prj8_drop_sentinels, prj9_clean_int, prj11_underspecified_fill, prj13_any_feature, prj14_document_blocks, prj17_cluster_id,
    )
}


# --- the same in SQL ---------------------------------------------------------------------------------------------------------


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_fold(expr: str) -> str:
    table_ = T.ascii_table()
    for c, a in table_.items():
        if len(a) != 1:
            expr = f"replace({expr}, chr({ord(c)}), {_quoted(a)})"
    single = {c: a for c, a in table_.items() if len(a) == 1}
    chars = " || ".join(f"chr({ord(c)})" for c in single)
    return f"translate({expr}, {chars}, {_quoted(''.join(single.values()))})"


def _sql_html(expr: str) -> str:
    from html.entities import codepoint2name

    expr = f"replace({expr}, '&', '&amp;')"
    for code, name in sorted(codepoint2name.items()):
        if 0xA0 <= code <= 0xFF:
            expr = f"replace({expr}, chr({code}), '&{name};')"
    return expr


def _sql_ngrams(expr: str, n: int) -> str:
    pad = "_" * (n - 1)
    padded = f"('{pad}' || lower({expr}) || '{pad}')"
    return f"case when length({expr}) > 0 then list_transform(range(1, length({padded}) - {n} + 2), lambda i: substr({padded}, i, {n})) else [] end"


_WORDS = "coalesce(regexp_extract_all(lower({}), '" + T.WORD.replace("{", "{{").replace("}", "}}") + "'), [])"
_COUNT = "select term, count(*) as n from (select unnest({}) as term from refmetas) group by term"
_B = lambda cols: f"list_sort(list_distinct([x for x in [{', '.join(cols)}] if x is not null]))"


def _sql_repid() -> str:
    parts, k = [], 0
    for cols in SLOTS.values():
        own = _B([f"cast({c} as varchar)" for c in cols]) if len(cols) > 1 else f"[cast({cols[0]} as varchar)]"
        for i in range(len(cols)):
            parts.append(f"'{k}*+' || coalesce(({own})[{i + 1}], 'None')")
            k += 1
    return "sha1(" + " || '#+*' || ".join(parts) + ")"


_CLEAN = lambda c, lo, hi: f"case when {c} >= {lo} and {c} <= {hi} then {c} end"
_SIMS = "round(i / (na + nb - i), 6) as jaccard, round(2 * i / (na + nb), 6) as dice, round(i / least(na, nb), 6) as overlap, round(i / sqrt(na * nb), 6) as cosine, round(i / na, 6) as probability"
_SHOWN = lambda cols: f"array_to_string({_B(cols)}, ',')"
_N = lambda cols: f"len({_B(cols)})"

SQL = {
    "sc1_ngrams": _COUNT.format(_sql_ngrams("title", 3)),
    "sc2_words": _COUNT.format(_WORDS.format("title")),
    "sc3_wordgrams": f"with w as (select {_WORDS.format('title')} as w from refmetas), g as (select unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) as term from w) select term, count(*) as n from g group by term",
    "sc5_ascii_fold": f"select refid, {_sql_fold('a1sur')} as folded from refmetas",
    "sc6_html_fold": f"select refid, {_sql_html('a1sur')} as folded from refmetas",
    "sc7_tokens": _COUNT.format(f"[t for t in regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+') if t not in ({', '.join(map(_quoted, dict.fromkeys(T.STOPWORDS)))})]"),
    "sc12_char_ngrams": f"with f as (select replace({_sql_fold('a1sur')}, ' ', '_') as s from refmetas), g as (select unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) as term from f) select term, count(*) as n from g group by term",
    "sc14_author_grams": f"with f as (select refid, {_sql_fold('lower(a1sur)')} as s from refmetas) select refid, array_to_string(({_sql_ngrams('s', 3)})[1:12], ' ') as grams from f",
    "sc15_year_pairs": f"select refid, case when year <= {NEXT_YEAR} then try_cast((year - 1) || '' || year as bigint) end as year1, case when year <= {NEXT_YEAR} then try_cast(year || '' || (year + 1) as bigint) end as year2 from refmetas",
    "sc16_author_norm": f"select refid, {_sql_fold('lower(a1sur)')} as name from refmetas",
    "sc17_bundle": f"select refid, s[1] as s1, s[2] as s2, s[3] as s3, s[4] as s4 from (select refid, {_B(SLOTS['surname'])} as s from refmetas)",
    "sc18_representation_id": f"select refid, {_sql_repid()} as repid from refmetas",
    "ag2_representations": f"select {_sql_repid()} as repid, count(*) as freq, min(refid) as first_refid from refmetas group by 1",
    "sc27_logistic": f"select matchid, round(1 / (1 + exp(-({BIAS} + {WEIGHTS['title']} * score))), 6) as p from repmatches",
    "sc28_set_similarities": f"with w as (select refid, list_distinct({_WORDS.format('title')}) as a, list_distinct({_WORDS.format('refstring')}) as b from refmetas), n as (select refid, len(a) as na, len(b) as nb, len(list_intersect(a, b)) as i from w) select refid, {_SIMS} from n where na > 0 and nb > 0",
    "sc29_threshold_curve": "select matchid, round(1.0 / (1 + exp(-5.0 * score) * 9.0), 6) as threshold from repmatches",
    "sc30_representation_text": f"select refid, 'init: {{' || {_SHOWN(SLOTS['init'])} || '}} surname: {{' || {_SHOWN(SLOTS['surname'])} || '}}' as shown from refmetas",
    "sc32_type_signature": f"select {_N(SLOTS['surname'])} as n_surname, {_N(SLOTS['init'])} as n_init, {_N(SLOTS['year'])} as n_year, count(*) as n_rows from refmetas group by 1, 2, 3",
    "sc33_identifiers": "select refid, coalesce(case " + " ".join(f"when frompipeline = 'matched_references_from_{t[:-2].rstrip('_')}' then {t}" for t in TARGETS) + " end, linkid) as built from refmetas",
    "src2_filtered_scan": "select refid, year, title from refmetas where year between 1990 and 2010 and refstring is not null",
    "src3_term_scan": "select refid, title from refmetas where frompipeline = 'matched_references_from_crossref'",
    "prj2_typed_extraction": f"select refid, {_CLEAN('year', 1500, NEXT_YEAR)} as year, coalesce(nullif(trim(title, ' '), ''), refstring) as title from refmetas",
    "prj3_author_slots": " union all ".join(f"select refid, {i} as pos, a{i}sur as sur, a{i}init as init, a{i}first as first from refmetas where a{i}sur is not null" for i in range(1, 5)),
    "prj5_target_flags": "select refid, " + ", ".join(f"{t} is not null as has_{t}" for t in TARGETS) + " from refmetas",
    "prj8_drop_sentinels": "select refid, case when title not in ('None', ' ', '') then title end as title from refmetas",
    "prj9_clean_int": f"select refid, {_CLEAN('year', 1500, NEXT_YEAR)} as year, {_CLEAN('volume', 1, 1000)} as volume, {_CLEAN('issue', 1, 1000)} as issue, {_CLEAN('issue', 1, 'volume')} as start, {_CLEAN('volume', 'issue', 10000)} as \"end\" from refmetas",
    "prj11_underspecified_fill": "select refid, case when coalesce(a1sur, e1sur) is null then cast(refid as varchar) else a1sur end as a1sur, case when coalesce(a1sur, e1sur) is not null and title is null and year is null then cast(refid as varchar) else title end as title from refmetas",
    "prj13_any_feature": "select refid from refmetas where coalesce(a1sur, title, source, cast(year as varchar)) is not null",
    "prj14_document_blocks": "with d as (select refid, regexp_extract(linkid, '_(doc[0-9]+)_ref_', 1) as doc from refmetas) select refid, doc, dense_rank() over (order by doc) as block from d where doc <> ''",
    "prj17_cluster_id": "select distinct duplicateid, regexp_replace(duplicateid, '_[^_]*$', '') as clusterid from dupmembers",
}
