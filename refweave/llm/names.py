"""Variant spellings of names typed by people (problem 2).

Merge-and-rematch resolution against an authority. Every entry starts a profile
with one spelling and one given name. A typed name is read in all ways it can
be read (surname first or last, with a comma, initials, the parts swapped).
Records meet profiles in blocks of shared one-deletion variants of a spelling;
a record that fits exactly one profile is merged: its spelling, given name and
initial join the profile. The profiles that have become richer re-enter blocking
with all they have, and the open records they meet are matched again, until a
round merges nothing. A name that two entries fit equally is left open, and so
is one whose given name speaks against the entry.

Familiar forms of given names are no list but are learned from merged evidence:
a form written beside the surnames of several entries, that nobody else bears,
stands for the given name that a good part of these entries share. A table of
further forms can be passed in.

Publishers go the same way: the words that many entries share stand in the
place of given names, the others are the spelling; legal forms and places fall
away, abbreviations are read as the words they shorten. General words and places
are tables that names are joined with, word by word.

Defined cases: null, blank and placeholder names have no entry; repeated rows
are resolved once and come out each; exact spellings match; an empty authority
or table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refweave.llm.survivor import NO_NAME
from refweave.llm.unify import compared, once
from refweave.operators.language import deletions
from refweave.sources.tables import cut, drop

COMMON = 5  # entries from which on a word of publishers' names is a general one
BEARERS, SHARE = 2, 0.3  # entries, and part of the entries it is seen with, from which on a form stands for a given name

# Words beside a name.
BESIDE = r"\b(?:prof|dr|hrsg|herausgeber|ed|eds|editor|et al|u a|and others|jr|sr)\b"
PARTICLES = r"^(?:(?:van der|van den|van|von der|von|vom|zu|de la|de|del|della|du|le|la|af|av|den|der|ter)\b ?)+"
# Legal forms of firms.
LEGAL = r"\b(?:gmbh|co|kg|ag|ltd|inc|llc|plc|s a|sa|se|ug|mbh)\b"
# Words that join the parts of a publisher's name and tell nothing.
JOINING = ("of", "and", "fur", "the", "und", "et", "u")


def _deletions(word: Column) -> Column:
    """The word and every form of it with one character left out."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


def _reading(sur: Column, given: Column) -> Column:
    bare = F.regexp_replace(F.trim(sur), PARTICLES, "")
    return F.struct(F.trim(F.when(F.length(bare) > 1, bare).otherwise(sur)).alias("spelling"), F.trim(given).alias("given"))


def _plainly(text: Column) -> Column:
    """Words parted by one space, of a text in which commas were kept."""
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def _compared(df: DataFrame, keep: list[str], *values: Column, commas: bool = False) -> DataFrame:
    """The kept columns and ``said``, the values in compared form.

    That form is an expression of hundreds of nodes and tables of letters, which the driver holds, prints and plans again
    with every use: it stands once for all values here, and once in a plan.
    """
    return once(df, keep, said=F.transform(F.array(*values), lambda v: compared(v, keep="," if commas else "")))


def prepared(records: DataFrame) -> DataFrame:
    """(rec, text, own, none) of (rec, sur, init, first).

    ``text`` is the typed surname field for comparison, ``own`` the given name or initial beside it, ``none`` whether a
    placeholder was typed.
    """
    beside = lambda c: F.when(F.instr(c, "_") > 0, F.substring_index(c, "_", -1))
    said = _compared(records, ["rec"], F.col("sur"), beside(F.col("first")), beside(F.col("init")), commas=True)
    sur, first, init = (F.col("said")[i] for i in range(3))
    text, own = F.trim(F.regexp_replace(sur, BESIDE, "")), F.coalesce(F.nullif(_plainly(first), F.lit("")), _plainly(init), F.lit(""))
    return said.select("rec", text.alias("text"), own.alias("own"), _plainly(sur).isin(*NO_NAME).alias("none"))


def readings(text: Column, own: Column) -> Column:
    """All ways to read a prepared name as spelling and given name."""
    left, right = F.trim(F.substring_index(text, ",", 1)), _plainly(F.substring(text, F.instr(text, ",") + 1, F.length(text)))
    plain = _plainly(text)
    words = F.split(plain, " ")
    n = F.size(words)
    joined = lambda part: F.array_join(part, " ")
    comma = (F.instr(text, ",") > 0) & (F.length(right) > 0)
    forms = [
        F.when(comma, _reading(left, right)),
        _reading(plain, own),
        F.when(n > 1, _reading(F.element_at(words, -1), joined(F.slice(words, 1, 1)))),
        F.when(n > 2, _reading(joined(F.slice(words, 2, n - 1)), F.element_at(words, 1))),
        F.when(n > 1, _reading(joined(F.slice(words, 1, n - 1)), F.element_at(words, -1))),
        F.when(F.length(own) > 2, _reading(own, plain)),
    ]
    return F.array_distinct(F.filter(F.array(*forms), lambda r: r.isNotNull() & (F.length(r["spelling"]) > 1)))


def familiar_forms(records: DataFrame, profiles: DataFrame) -> DataFrame:
    """(short, names): given names that a form beside a surname may stand for, learned from (spelling, given) of records.

    Only spellings of one entry count. A form counts once per entry, however often it is written.
    """
    sole = profiles.groupBy("spelling").agg(F.count("*").alias("k"), F.first("nameid").alias("nameid"), F.first(F.substring_index("given", " ", 1)).alias("name")).where("k = 1 and length(name) > 1")
    seen = records.select("spelling", F.substring_index("given", " ", 1).alias("short")).where("length(short) > 1").distinct()
    pairs = seen.join(sole.select("spelling", "nameid", "name"), "spelling").groupBy("short", "name").agg(F.countDistinct("nameid").alias("n"))
    # The names that one form goes with are few, as an authority has few given names.
    part = F.col("n") / F.sum("n").over(Window.partitionBy("short"))
    good = pairs.withColumn("part", part).where((F.col("n") >= BEARERS) & (F.col("part") >= SHARE) & (F.col("short") != F.col("name")))
    return good.groupBy("short").agg(F.array_join(F.sort_array(F.collect_set("name")), " ").alias("names"))


def with_full(records: DataFrame, forms: DataFrame) -> DataFrame:
    """Adds ``full``: the given name's first word and the names it may stand for."""
    first = records.withColumn("short", F.substring_index("given", " ", 1))
    return first.join(forms, "short", "left").withColumn("full", F.concat_ws(" ", "short", "names")).drop("short", "names")


def _given_fit(given: Column, full: Column, forms: Column, initials: Column) -> Column:
    """3 the given name, 2 its beginning, 1 its initial, 0 nothing to compare, -1 against it."""
    first = F.substring_index(given, " ", 1)
    near = lambda f, u: (f == u) | ((F.length(u) >= 4) & (F.length(f) >= 4) & (F.levenshtein(f, u) <= F.when(F.length(u) >= 6, 2).otherwise(1)))
    same = F.exists(F.split(full, " "), lambda u: F.exists(forms, lambda f: near(f, u)))
    begins = F.exists(forms, lambda f: f.startswith(first))
    return F.when(F.length(given) == 0, 0).when(same, 3).when(begins & (F.length(first) > 1), 2).when(F.array_contains(initials, F.substring(first, 1, 1)) & (F.length(first) == 1), 1).otherwise(-1)


def _blocked(spellings: DataFrame) -> DataFrame:
    return spellings.select("nameid", F.col("spelling").alias("known")).distinct().withColumn("block", F.explode(_deletions(F.col("known"))))


def resolve(profiles: DataFrame, records: DataFrame, fit) -> DataFrame:
    """(rec, nameid): records (rec, spelling, given, full), one row per reading, resolved to profiles (nameid, spelling, given).

    fit(given, full, forms, initials): how well a given part fits those of a profile, -1 if it speaks against it.
    """
    # Exploded variants of names are far smaller as files than in memory: "merge" keeps the planner from taking them for small.
    records = cut(records.where("spelling is not null and length(spelling) > 1"))
    open_blocks = cut(records.withColumn("block", F.explode(_deletions(F.col("spelling")))).select("block", "rec", "spelling", "given", "full"))
    evidence = cut(profiles.select("nameid", "spelling", "given").distinct())
    resolved, richer = [], None
    while True:
        entering = open_blocks
        if richer is not None:
            # All that a richer profile has re-enters; an open record that meets it meets all profiles, as it must see a second fit.
            again = _blocked(evidence.join(richer.select("nameid").distinct(), "nameid", "left_semi"))
            touched = open_blocks.select("block", "rec").join(again.select("block").distinct().hint("merge"), "block", "left_semi").select("rec").distinct()
            entering = open_blocks.join(touched.hint("merge"), "rec", "left_semi")
        forms = evidence.groupBy("nameid").agg(F.collect_set(F.when(F.length("given") > 1, F.col("given"))).alias("forms"), F.collect_set(F.substring("given", 1, 1)).alias("initials"))
        met = entering.join(_blocked(evidence).hint("merge"), "block")
        met = met.groupBy("rec", "spelling", "given", "full", "nameid").agg(F.min(F.levenshtein("spelling", "known")).alias("away"))
        # Two changed letters are at most a transposition; short names must agree.
        met = met.where("away <= least(2, length(spelling) div 4)")
        fits = met.join(forms.hint("merge"), "nameid").withColumn("fit", fit(F.col("given"), F.col("full"), F.col("forms"), F.col("initials"))).where("fit >= 0")
        best = fits.groupBy("rec", "nameid").agg(F.max(F.struct((-F.col("away")).alias("near"), "fit", "spelling", "given")).alias("best"))
        ranks = best.select("rec", "nameid", "best.*")
        first = Window.partitionBy("rec")
        ranks = ranks.withColumn("top", F.max(F.struct("near", "fit")).over(first)).where("struct(near, fit) = top").withColumn("ties", F.count("*").over(first))
        merged = cut(ranks.where("ties = 1").select("rec", "nameid", "spelling", "given"))
        if merged.isEmpty():
            break
        resolved.append(merged)
        now = cut(merged.select("nameid", "spelling", "given").distinct().join(evidence.hint("merge"), ["nameid", "spelling", "given"], "left_anti"))
        drop(richer)
        richer = now
        if richer.isEmpty():
            break
        wider = cut(evidence.union(richer))
        left = cut(open_blocks.join(merged.select("rec").hint("merge"), "rec", "left_anti"))
        drop(evidence, open_blocks)
        evidence, open_blocks = wider, left
    drop(open_blocks, evidence, richer)
    out = records.select("rec", F.lit(None).cast("long").alias("nameid")).limit(0) if not resolved else None
    for merged in resolved:
        part = merged.select("rec", "nameid")
        out = part if out is None else out.union(part)
    return out


def entries(authority: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Persons (nameid, spelling, given) and firms (nameid, orgname, org, place) of the authority.

    orgname is as it is written; org and place are in compared form.
    """
    written = ("surname", F.coalesce("firstname", F.lit("")), "orgname", "place")
    said = cut(_compared(authority.where("kind in ('person', 'publisher')"), ["nameid", "kind", "surname", "orgname"], *(F.col(w) if isinstance(w, str) else w for w in written)))
    name = _reading(F.col("said")[0], F.col("said")[1])
    people = said.where("kind = 'person' and surname is not null").select("nameid", name.alias("r")).select("nameid", "r.spelling", "r.given")
    firms = said.where("kind = 'publisher' and orgname is not null").select("nameid", "orgname", F.col("said")[2].alias("org"), F.col("said")[3].alias("place"))
    return people, firms


def publisher_text(name: Column) -> Column:
    """A publisher's name in compared form without its legal form."""
    return F.regexp_replace(F.trim(F.regexp_replace(name, LEGAL, "")), r"\b(?:u p|up)\b", "university press")


def publisher_readings(names: DataFrame, firms: DataFrame) -> DataFrame:
    """(id, spelling, given) of publishers' names (id, name): their own words and their general words, each sorted.

    Names and firms (org, place) are in compared form. A word that COMMON entries or more share is a general one. A beginning of general
    words stays as it is written, as it may be that of several; a word of five letters or more within two edits of a
    general word, or one made of some of its letters from the first to the last, is read as that, the most frequent first.
    """
    split = lambda text: F.filter(F.split(text, " +"), lambda w: (F.length(w) > 0) & ~w.isin(*JOINING))
    general = cut(firms.select(F.explode(F.array_distinct(split(F.col("org")))).alias("g")).groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON))
    places = firms.select(F.explode(F.split("place", " ")).alias("w")).where("length(w) > 2").distinct()
    tokens = cut(names.select("id", F.explode(split(publisher_text(F.col("name")))).alias("w")).join(places, "w", "left_anti"))
    words = cut(tokens.select("w").distinct())
    begins = general.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("g")), lambda i: F.substring("g", F.lit(1), i))).alias("w")).where("length(w) > 1").distinct()
    known = words.join(begins, "w", "left_semi").select("w", F.col("w").alias("g"))
    other = words.join(begins, "w", "left_anti")
    form = lambda df, c: df.withColumn("form", F.explode(deletions(F.col(c), 2)))
    typo = form(other.where("length(w) >= 5"), "w").join(form(general, "g"), "form").where("levenshtein(w, g) <= 2").select("w", "g", "n", F.lit(0).alias("kind"))
    ends = lambda c: (F.substring(c, 1, 1), F.substring(c, -1, 1))
    side = lambda df, c: df.withColumns({"first": ends(c)[0], "last": ends(c)[1]})
    within = side(other.where("length(w) >= 3"), "w").join(side(general, "g"), ["first", "last"]).where("length(w) < length(g) and g like regexp_replace(w, '(.)', '$1%')")
    short = within.select("w", "g", "n", F.lit(1).alias("kind"))
    read = typo.union(short).groupBy("w").agg(F.min_by("g", F.struct("kind", (-F.col("n")).alias("n"), "g")).alias("g"))
    told = tokens.join(known.union(read), "w", "left")
    line = lambda c: F.array_join(F.array_sort(c), " ")
    return told.groupBy("id").agg(line(F.collect_list(F.when(F.col("g").isNull(), F.col("w")))).alias("spelling"), line(F.collect_set("g")).alias("given"))


def _initials(name: Column) -> Column:
    """The first letters of the words of a publisher's name in compared form that aren't joining words."""
    return F.array_join(F.transform(F.filter(F.split(name, " "), lambda w: ~w.isin(*JOINING)), lambda w: F.substring(w, 1, 1)), "")


def _general_fit(given: Column, full: Column, forms: Column, initials: Column) -> Column:  # noqa: ARG001
    told = lambda text: F.filter(F.split(text, " "), lambda w: F.length(w) > 0)
    mine = told(given)
    part = lambda f: F.forall(mine, lambda m: F.exists(told(f), lambda t: t.startswith(m)))
    same = F.exists(forms, lambda f: (F.size(told(f)) == F.size(mine)) & part(f))
    return F.when(same, 3).when(F.size(mine) == 0, 0).when(F.exists(forms, part), 2).otherwise(-1)


def resolved_names(refs: DataFrame, authority: DataFrame, nicknames: DataFrame | None = None) -> DataFrame:
    """(refid, fieldname, nameid) for a1sur, e1sur and publisher1 of every row.

    nicknames: further familiar forms (short, name), in compared form.
    """
    people, firms = entries(authority)
    typed = lambda f: F.struct(F.lit(f"{f}1sur").alias("fieldname"), F.col(f"{f}1sur").alias("sur"), F.col(f"{f}1init").alias("init"), F.col(f"{f}1first").alias("first"))
    rows = refs.select("refid", F.explode(F.array(typed("a"), typed("e"))).alias("t")).select("refid", "t.*")
    rows = cut(rows.where("sur is not null").withColumn("rec", F.xxhash64("sur", F.coalesce("init", F.lit("\0")), F.coalesce("first", F.lit("\0")))))
    records = rows.groupBy("rec").agg(F.first("sur").alias("sur"), F.first("init").alias("init"), F.first("first").alias("first"))
    records = cut(prepared(records)).where("not none")
    read = cut(records.select("rec", F.explode(readings(F.col("text"), F.col("own"))).alias("r")).select("rec", "r.spelling", "r.given"))
    forms = familiar_forms(read, people)
    if nicknames is not None:
        more = nicknames.groupBy("short").agg(F.array_join(F.sort_array(F.collect_set("name")), " ").alias("names"))
        forms = forms.unionByName(more).groupBy("short").agg(F.array_join(F.sort_array(F.collect_set("names")), " ").alias("names"))
    typed_by = rows.select("refid", "fieldname", "rec").join(resolve(people, with_full(read, cut(forms)), _given_fit), "rec").select("refid", "fieldname", "nameid")

    names = refs.select("refid", F.col("publisher1").alias("rec")).where("rec is not null")
    spelt = cut(_compared(names.select("rec").distinct(), ["rec"], F.col("rec")).select("rec", F.col("said")[0].alias("name")))
    # Names of entries and typed names are read together; an entry goes by its number, a typed name by itself.
    both = firms.select(F.struct("nameid", F.lit(None).cast("string").alias("rec")).alias("id"), F.col("org").alias("name")).union(spelt.select(F.struct(F.lit(None).cast("long").alias("nameid"), "rec"), "name"))
    told = cut(publisher_readings(both, firms)).select("id.nameid", "id.rec", "spelling", "given")
    # Firms are also known by their initials, and partnerships by the first partner.
    partners = firms.where("orgname like '%&%'").select("nameid", F.substring_index("org", " ", 1), F.lit(""))
    profiles = told.where("nameid is not null").select("nameid", "spelling", "given").union(firms.select("nameid", _initials(F.col("org")), F.lit(""))).union(partners)
    capitals = spelt.where(F.trim("rec").rlike(r"^\p{Lu}{2,}$")).select("rec", F.lower(F.trim("rec")).alias("spelling"), F.lit("").alias("given"))
    read = told.where("rec is not null").select("rec", "spelling", "given").union(capitals).withColumn("full", F.col("given"))
    houses = names.join(resolve(profiles, read, _general_fit), "rec").select("refid", F.lit("publisher1").alias("fieldname"), "nameid")
    return typed_by.union(houses)
