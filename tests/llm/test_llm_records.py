import random
from datetime import datetime

from refweave.llm import names, survivor

REFS = "refid bigint, a1sur string, a1init string, a1first string, e1sur string, e1init string, e1first string, publisher1 string, nameid int"
AUTHORITY = "nameid bigint, kind string, surname string, firstname string, orgname string, place string"


def resolve(spark, refs, authority, short=()):
    nicknames = spark.createDataFrame(short, "short string, name string") if short else None
    got = names.resolved_names(spark.createDataFrame(refs, REFS), spark.createDataFrame(authority, AUTHORITY), nicknames).collect()
    return {(r.refid, r.fieldname): r.nameid for r in got}


def test_variants_of_one_entry(spark):
    people = [(1, "person", "Klöråżhoff", "Rebecca", None, None), (2, "person", "van der Menind", "José", None, None), (3, "person", "Belkibwick", "Ulrike", None, None), (4, "person", "Belckibwick", "Henrietta", None, None), (5, "person", "Belkibwick", "Anna", None, None)]
    houses = [(10 + i, "publisher", None, None, f"{n} University Press", "Quarnstedt") for i, n in enumerate(("Tomton", "Alpen", "Seeland", "Marsk", "Holm"))] + [(20 + i, "publisher", None, None, f"{n} Verlag", "Hestermoor") for i, n in enumerate(("Tomton", "Norda", "Sudan", "Ostra", "Westa"))]
    rows = [
        (1, "Klöråżhoff", None, None), (2, "KLORAZHOFF, R.", None, None), (3, "Rebecca", "Rebecca_K.", "Rebecca_Klöråżhoff"), (4, "Klöråhżoff", "Klöråhżoff_B.", "Klöråhżoff_Becky"), (5, "Klöråżhoff", "Klöråżhoff_B.", None),
        (6, "Menind", "Menind_J", None), (7, "Belkibwick", "Belkibwick_U.", None), (8, "Belkibwick", None, None), (9, "Klöråżhoff", "Klöråżhoff_X.", None), (10, "u. a.", None, None), (11, None, None, None), (12, "Nobody", None, None), (1, "Klöråżhoff", None, None),
    ]
    refs = [(r, s, i, f, None, None, None, None, 0) for r, s, i, f in rows]
    refs += [(30, None, None, None, "Prof. Belckibwick", None, None, "Tomton Univ. Pr., Quarnstedt", 0), (31, None, None, None, None, None, None, "Hestermoor: tomton vlg. GmbH", 0), (32, None, None, None, None, None, None, "Tomton", 0), (33, None, None, None, None, None, None, "Press of Alpen University", 0), (34, None, None, None, None, None, None, "Alpen Verlag", 0)]
    got = resolve(spark, refs, people + houses, [("becky", "rebecca")])
    assert {r: got.get((r, "a1sur")) for r in range(1, 13)} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: 3, 8: None, 9: None, 10: None, 11: None, 12: None}
    assert got[(30, "e1sur")] == 4
    assert {r: got.get((r, "publisher1")) for r in range(30, 35)} == {30: 10, 31: 20, 32: None, 33: 11, 34: None}


def test_familiar_forms_are_learned_from_other_entries(spark):
    people = [(i, "person", f"{s}berg", "Rebecca" if i < 4 else "Walter", None, None) for i, s in enumerate(("Klora", "Menin", "Tulka", "Sarvo", "Ostri", "Velka"))] + [(9, "person", "Norbygard", "Rebecca", None, None), (10, "person", "Norbygard", "Walter", None, None)]
    rows = [(i, f"{s}berg", None, f"{s}berg_Becky", None, None, None, None, 0) for i, s in enumerate(("Klora", "Menin", "Tulka"))]
    rows += [(7, "Norbygard", None, "Norbygard_Becky", None, None, None, None, 0), (8, "Ostriberg", None, "Ostriberg_Zoe", None, None, None, None, 0)]
    got = resolve(spark, rows, people)
    assert {r: got.get((r, "a1sur")) for r in (0, 1, 2, 7, 8)} == {0: 0, 1: 1, 2: 2, 7: 9, 8: None}


def test_no_authority_and_no_rows(spark):
    row = [(1, "A", None, None, None, None, None, "B", 0)]
    assert resolve(spark, row, []) == {}
    assert resolve(spark, [], [(1, "person", "A", "B", None, None)]) == {}


def test_the_compared_form_stands_once_in_a_plan(spark, monkeypatch):
    def nodes(e):
        return 1 + sum(nodes(e.children().apply(i)) for i in range(e.children().size()))

    def largest(df):
        """The most nodes in the expressions of one step of the plan."""
        plan, most = [df._jdf.queryExecution().optimizedPlan()], 0
        while plan:
            step = plan.pop()
            most = max(most, sum(nodes(step.expressions().apply(i)) for i in range(step.expressions().size())))
            plan += [step.children().apply(i) for i in range(step.children().size())]
        return most

    seen, cut = [], names.cut
    monkeypatch.setattr(names, "cut", lambda df: seen.append(largest(df)) or cut(df))
    one = largest(spark.createDataFrame([("A",)], "v string").select(names.compared(names.F.col("v")).alias("v")))
    refs = [(1, "Klora", None, "Klora_Becky", None, None, None, "Tomton Verlag", 0)]
    assert resolve(spark, refs, [(1, "person", "Klora", "Becky", None, None), (2, "publisher", None, None, "Tomton Verlag", "Holm")]) == {(1, "a1sur"): 1, (1, "publisher1"): 2}
    large = [n for n in seen if n > 0.8 * one]
    assert max(large) < 1.5 * one and len(large) < 5


MEMBER = "duplicateid string, refid bigint"
ROW = "refid bigint, title string, year bigint, a1sur string, source string, frompipeline string, extracted_at timestamp, consensus string"
FULL = "Norm ohne Umwelt? Zur privaten Bibliothek der Risiko nach dem Wandel von Duninerholm"


def found(spark, rows, members):
    at = datetime(2024, 1, 1)
    refs = spark.createDataFrame([(*r[:6], r[6] if len(r) > 6 else at, "x") for r in rows], ROW)
    trust = spark.createDataFrame([("good", 9), ("poor", 1)], "pipeline string, trust bigint")
    got = survivor.survivors(refs, spark.createDataFrame(members, MEMBER), trust).collect()
    return {(r.duplicateid, r.fieldname): r.refid for r in got}


def test_survivors(spark):
    rows = [
        (1, FULL[:40], 201, "ders.", "ebd.", "good"), (2, FULL, 2001, "Mller", "S. 25-36", "poor", datetime(2024, 2, 1)), (3, FULL, None, None, "Annals", "poor", datetime(2024, 1, 5)), (4, "n/a", 9999, "[38]", None, "good"),
        (5, FULL, 2001, "Müller", "Annals", None), (6, " ", None, "", "Bd. 3", "good"), (7, FULL, 2001, "Müller", "Annals", "poor", datetime(2024, 2, 1)),
    ]
    got = found(spark, rows, [("g", i) for i in (1, 2, 3, 4, 5, 7, 99)] + [("g", 2), ("h", 6), (None, 1), ("k", None)])
    assert got == {("g", "title"): 2, ("g", "year"): 2, ("g", "a1sur"): 2, ("g", "source"): 7}
    assert found(spark, [], []) == {}


def test_consensus_line():
    lines = [("norm ohne umwelt zur bibliothek", 3.0), ("norm ohne umwlt zur privaten bibliothek", 1.0), ("norm ohne umwelt zur privaten bibliothek", 1.0), ("norm", 1.0)]
    assert survivor.consensus_line(lines).startswith("norm ohne umwelt zur")
    assert survivor.consensus_line([("a b c", 1.0)]) == "a b c"


def test_large_groups_are_aligned_in_chunks(spark):
    words = [f"w{i}" for i in range(12)]
    lines = [("g", "title", " ".join(words[:k] + [f"typo{j}"] + words[k + 1 :]), 1.0) for k in range(12) for j in range(60)]
    got = survivor.consensus(spark.createDataFrame(lines, "duplicateid string, fieldname string, line string, weight double")).collect()
    assert [r.consensus for r in got] == [" ".join(words)]


def test_existing_value_closest_to_the_consensus(spark):
    refs = spark.createDataFrame([(i, t, 2000, "A", "S", "good", None, "x") for i, t in enumerate([FULL.replace("Norm", "Nrm"), FULL, FULL[:50], FULL.replace("Umwelt", "Umwlet")])], ROW)
    members = spark.createDataFrame([("g", i) for i in range(4)], MEMBER)
    got = survivor.consensus_values(refs, members, spark.createDataFrame([("good", 9)], "pipeline string, trust bigint")).collect()
    assert {r.value for r in got if r.fieldname == "title"} == {FULL}


def test_consensus_beats_the_most_frequent_value(spark):
    rng = random.Random(6)
    rows, members, truth, frequent = [], [], {}, {}
    for g in range(30):
        words = [rng.choice(FULL.split()) + str(rng.randrange(99)) for _ in range(8)]
        truth[g, "title"], truth[g, "year"] = " ".join(words), str(1950 + g)
        broken = " ".join(words[:-1] + ["zzz"])
        slips = [" ".join(w if k != slip else w[:-1] for k, w in enumerate(words)) for slip in rng.sample(range(8), 4)]
        titles = [broken, broken, *slips, truth[g, "title"]]
        years = [1950 + g, 1850 + g, 1950 + g, 1950 + g, 1960 + g, None, 1950 + g]
        frequent[g, "title"] = broken
        for k, (title, year) in enumerate(zip(titles, years, strict=True)):
            rows.append((100 * g + k, title, year, "A", "S", "good", None, "x"))
            members.append((str(g), 100 * g + k))
    got = survivor.consensus_values(spark.createDataFrame(rows, ROW), spark.createDataFrame(members, MEMBER), spark.createDataFrame([("good", 9)], "pipeline string, trust bigint")).collect()
    values = {(int(r.duplicateid), r.fieldname): r.value for r in got}
    right = sum(values[k] == v for k, v in truth.items())
    assert right == len(truth) and not any(frequent[k] == truth[k] for k in frequent)
