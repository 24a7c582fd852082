"""Operators of keyed tables, files, groups and lattices against hand-made cases and brute force."""

import math
import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from refweave.operators import evaluate as E
from refweave.operators import language as L
from refweave.operators import lattice as A
from refweave.operators import similarity as S
from refweave.operators.relabel import relabel
from refweave.sources import files as FI
from refweave.sources.keyed import KeyedTable, read_samples, write_samples


def test_keyed_table(spark, tmp_path):
    held = KeyedTable(spark, str(tmp_path / "t"), "k")
    held.create(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "c", 3.0)], "k int, s string, x double"))
    with pytest.raises(FileExistsError):
        held.create(held.read())
    held.overwrite(spark.createDataFrame([(2, "late", 9.0), (2, "early", 8.0), (5, "new", 5.0), (None, "n", 0.0)], "k int, s string, x double"), [F.col("x")])
    assert {tuple(r) for r in held.read().collect()} == {(1, "a", 1.0), (2, "late", 9.0), (5, "new", 5.0)}
    held.update(spark.createDataFrame([(1, None), (7, 1.5)], "k int, x double"))
    assert {tuple(r) for r in held.read().collect()} == {(1, "a", None), (2, "late", 9.0), (5, "new", 5.0)}
    # A version without its mark of completion is not read.
    (tmp_path / "t" / "version=9").mkdir()
    assert held.read().count() == 3


def test_sample_files(spark, tmp_path):
    for name, rows in (("a", [(0.1, 1)]), ("b", [(1e-7, 0), (0.25, 1)])):
        write_samples(spark.createDataFrame(rows, "x double, y long"), str(tmp_path / "s"), name)
    assert sorted(tuple(r) for r in read_samples(spark, str(tmp_path / "s"), "x double, y long").collect()) == [(1e-7, 0), (0.1, 1), (0.25, 1)]


def test_relabel_leaves_out_large_groups(spark):
    rows = [(i, "a" if i < 3 else "big" if i < 10 else None) for i in range(12)]
    done, skipped = relabel(spark.createDataFrame(rows, "id int, g string"), "g", "label", lambda x: pd.Series(x["id"].to_numpy() % 2, x.index), 5)
    assert {r.id: r.label for r in done.collect()} == {0: "a_0", 1: "a_1", 2: "a_0"} | {i: None for i in range(3, 12)}
    assert [tuple(r) for r in skipped.collect()] == [("big", 7)]


def test_nested_pairs(spark):
    df = spark.createDataFrame([(1, ("x", 2), [("S", None), ("T", "t")], ["p", "q"])], "id int, n struct<a:string,b:int>, l list, e array<string>".replace("l list", "l array<struct<sur:string,first:string>>"))
    assert sorted((r.attr, r.value) for r in FI.nested_pairs(df, "id").collect()) == [("_e", "p"), ("_e", "q"), ("_n_a", "x"), ("_n_b", "2"), ("l_first", "t"), ("l_sur", "S"), ("l_sur", "T")]


def test_constraints():
    assert FI.read_constraints("a + b\na + c\n\nb - d\n") == ({"a": ["b", "c"]}, {"b": ["d"]})


def test_byte_hash():
    # Published test values of the hash.
    assert [f"{x:x}" for x in S.fnv1a(["", "a", "foobar"]).tolist()] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]


@pytest.mark.parametrize("k", [3, 7])
def test_hamming_pairs_against_all_pairs(spark, k):
    rng = random.Random(k)
    bits = [rng.getrandbits(64) for _ in range(25)]
    bits += [b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 9))) for b in bits for _ in range(3)]
    bits = list(dict.fromkeys(bits))
    prints = spark.createDataFrame([(i, *[b >> (8 * j) & 255 for j in range(8)]) for i, b in enumerate(bits)], "rec long, " + ", ".join(f"b{j} int" for j in range(8)))
    want = {(i, j, (x ^ y).bit_count()) for (i, x), (j, y) in combinations(enumerate(bits), 2) if (x ^ y).bit_count() <= k}
    got = [tuple(r) for r in S.hamming_pairs(prints, k).collect()]
    assert set(got) == want and len(got) == len(want)


def test_density_clusters(spark):
    pairs = [(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.9), (3, 4, 0.8), (5, 6, 0.9), (7, 8, 0.2)]
    got = {r.rec: r.cluster for r in S.dbscan(spark.createDataFrame(pairs, "a long, b long, sim double"), spark.createDataFrame([(i,) for i in range(1, 10)], "rec long"), 0.5).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: None, 6: None, 7: None, 8: None, 9: None}


def test_smoothing_against_matrices(spark):
    m = np.array([[1, 1, 0], [1, 0, 1], [1, 1, 1], [0, 0, 1]])
    rows = [(i, f"f{j}") for i in range(4) for j in range(3) if m[i, j]]
    ff = (m.T / m.sum(1)) @ (m / m.sum(0))
    ff = ff / np.diag(ff)[:, None]
    got = {(r.f, r.g): r.weight for r in S.smoothing(spark.createDataFrame(rows, "rec long, f string")).collect()}
    assert got == pytest.approx({(f"f{i}", f"f{j}"): ff[i, j] for i in range(3) for j in range(3) if ff[i, j] >= 0.5})


def test_smoothing_keeps_all_that_weighs_its_limit(spark):
    # Of the records of every g, as many of each size, half have f; each h has one record more.
    rows = []
    for n in range(1, 20):
        for name, more in (("g", 0), ("h", 1)):
            for k in range(2 * n + more):
                for size in (2, 3, 7):
                    at = f"{name}{n}-{k}-{size}"
                    rows += [(at, v) for v in (f"{name}{n}", "f" if k < n else f"x{at}", *[f"y{at}-{i}" for i in range(size - 2)])]
    got = {r.g: r.weight for r in S.smoothing(spark.createDataFrame(rows, "rec string, f string")).where("f = 'f' and g rlike '^[gh]'").collect()}
    assert got == pytest.approx({f"g{n}": 0.5 for n in range(1, 20)})


def test_expanded_lattice(spark):
    sets = spark.createDataFrame([(["a", "b", "c"], 2), (["b", "a"], 5), (["c"], 1)], "fs array<string>, obs long")
    got = {"".join(r.fs): (r.obs, r.car) for r in A.expanded(sets).collect()}
    assert got == {"abc": (2, 2), "ab": (5, 7), "ac": (0, 2), "bc": (0, 2), "a": (0, 7), "b": (0, 7), "c": (1, 3)}


def test_discounting_keeps_the_sum(spark):
    nodes = spark.createDataFrame([("a", 4, 10), ("ab", 4, 6), ("abc", 2, 2)], "rep string, obs long, car long")
    edges = spark.createDataFrame([("a", "ab"), ("ab", "abc")], "sub string, sup string")
    got = {r.rep: r.obs for r in A.discounted(nodes, edges, 0.5).collect()}
    assert sum(got.values()) == pytest.approx(10)
    # a weighs 0.6 to ab and 0.4 to itself.
    assert got["a"] == pytest.approx(2 + 2 * 0.4) and got["abc"] == pytest.approx(1 + 1 + 2 * (2 / 6) / (2 / 6 + 4 / 6))


def test_weighted_gini(spark):
    rng = random.Random(2)
    x, w = [rng.randint(1, 9) for _ in range(40)], [rng.randint(1, 5) for _ in range(40)]
    order = sorted(range(40), key=lambda i: x[i])
    cw, cxw = np.cumsum([w[i] for i in order]), np.cumsum([x[i] * w[i] for i in order])
    want = ((cxw[1:] * cw[:-1] - cxw[:-1] * cw[1:]).sum()) / (cxw[-1] * cw[-1])
    got = E.weighted_gini(spark.createDataFrame(list(zip(x, w, strict=True)), "x long, weight long")).first().gini
    assert got == pytest.approx(want, abs=1e-6)


def test_pair_samples_against_loops(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, 4, 5])) for i in range(60)]
    by = {}
    for m, g in rows:
        by.setdefault(g, []).append(m)
    equal, different = [], []
    for g in sorted(by):
        if len(equal) < 50:
            equal += list(combinations(sorted(by[g]), 2))[:30]
    for g, h in combinations(sorted(by), 2):
        if len(different) < 12:
            different += [(a, b) for a in sorted(by[g]) for b in sorted(by[h])][:3]
    got = E.pair_samples(spark.createDataFrame(rows, "mention long, label long"), 30, 50, 3, 12).collect()
    assert sorted((r.a, r.b) for r in got if r.equal) == sorted(equal)
    assert sorted((r.a, r.b) for r in got if not r.equal) == sorted(different)


def test_compounds_of_many_parts(spark):
    words = [("hausbootsverleih",), ("hausboot",), ("hausxyz",), ("haus",)]
    terms = [("haus",), ("boot",), ("verleih",), ("hausboot",)]
    got = {r.word: r.parts for r in L.compounds(spark.createDataFrame(words, "word string"), spark.createDataFrame(terms, "term string")).collect()}
    assert got == {"hausbootsverleih": ["hausboot", "verleih"], "hausboot": ["haus", "boot"]}
    fewer = spark.createDataFrame([("haus",), ("boot",), ("verleih",)], "term string")
    assert {r.word: r.parts for r in L.compounds(spark.createDataFrame(words[:1], "word string"), fewer).collect()} == {"hausbootsverleih": ["haus", "boot", "verleih"]}


def test_spacing(spark):
    texts = [("the long house of windows",)] * 3 + [("long houses",), ("wind ows",), (None,), ("",)]
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "id int, t string")
    counts = L.context_counts(spark.createDataFrame([("windows " * 400 + "a b c d e f g h " * 40 + "wind ows",)], "t string"), "t", 3)
    got = {r.id: r.corrected for r in L.separations(df, "t", counts).collect()}
    assert got[4] == "windows" and got[0] == texts[0][0] and got[5] is None and got[6] == ""


def test_curves(spark):
    from refweave.functions import text as T

    row = spark.createDataFrame([(8.0,)], "x double").select(T.root_curve(F.col("x"), 2.0, 3.0, 0.5).alias("r"), T.double_logistic_curve(F.col("x"), 1.0, 4.0, 0.1).alias("d")).first()
    curve = lambda t, g, k, f0: g / (1 + math.exp(-k * g * t) * (g / f0 - 1))
    assert row.r == pytest.approx(3.5) and row.d == pytest.approx(curve(8, 1, 1, 0.1) + curve(8, 1, 0.25, 0.1 / 8000))


@pytest.mark.parametrize("threshold", [0.1, 0.01])
def test_linked_pairs_are_those_of_all_scores(spark, threshold):
    rng = random.Random(3)
    rows = []
    for rec in range(40):
        grams = rng.sample(range(30), 12) if rec % 3 else list(range(10)) + [rng.randrange(30)]
        rows += [("g" if rec < 30 else "h", rec, "title", f"t{g}") for g in set(grams)]
        rows += [("g" if rec < 30 else "h", rec, t, v) for t, v in (("pubnumber", "issue=None"), ("init", f"i{rng.randrange(3)}"), ("source", f"s{rng.randrange(4)}"), ("surname", f"n{rng.randrange(4)}")) if rng.random() < 0.8]
    features = spark.createDataFrame(rows, "grp string, rec long, ftype string, value string")
    want = {(r.a, r.b) for r in S.pair_scores(features).where(F.col("score") > threshold).collect()}
    assert {(r.a, r.b) for r in S.linked_pairs(features, threshold).collect()} == want and want


def test_name_measures(spark):
    from difflib import SequenceMatcher

    from refweave.operators import classify as K

    rows = [("Müller-Lüdenscheidt", "Lüdenscheid Mueller"), ("a b", ""), (None, "x"), ("2001", "2002"), ("Smith", "Smyth")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [tuple(r) for r in df.select(*[K.measured(k, F.col("a"), F.col("b")).alias(k) for k in ("unmatched", "cost", "similar", "assigned")]).collect()]
    matched = sum(m.size for m in SequenceMatcher(None, rows[0][0].lower(), rows[0][1].lower()).get_matching_blocks())
    assert got[0][0] == 19 - matched and got[0][3] == K.cost("Müller", "Mueller") + K.cost("Lüdenscheidt", "Lüdenscheid")
    assert got[1][3] == 0 and all(x is None or x != x for x in got[2])
    assert got[3][2] == 1 and got[4][2] == float(K.cost("Smith", "Smyth") / 5 < 0.25)


def test_word_bigrams(spark):
    texts = [(1, "Das alte Haus am See: Hausboote und Glashaus"), (2, "Haus"), (3, None), (4, "alte Hauss Qwrtz")]
    terms = [("alte", 9), ("haus", 9), ("see", 3), ("boote", 3), ("glas", 3)]
    got = {r.id: r.terms for r in L.word_bigrams(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame(terms, "term string, freq long"), ("das", "am", "und"), spark.createDataFrame([("boote", "boot")], "word string, base string")).collect()}
    assert got == {1: ["alte haus", "see", "haus boot", "glas haus"], 2: ["haus"], 4: ["alte haus", "qwrtz"]}


def test_stream_of_mentions(spark, tmp_path):
    from refweave.streaming.incremental import counted_by_window, label_stream

    spark.createDataFrame([("r1", "7")], "repid string, label string").write.parquet(str(tmp_path / "known"))
    new = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, None), (1, "r1")], "mentionid long, repid string")
    new.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    label_stream(spark, source, str(tmp_path / "known"), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    assert {(r.mentionid, r.label) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "7"), (2, "s_r2")}
    events = spark.sql("select timestamp'2024-01-01 10:00:00' as ts, 'a' as event_type union all select timestamp'2024-01-01 23:59:59', 'a' union all select timestamp'2024-01-02 00:00:00', 'a'")
    assert sorted(r.n for r in counted_by_window(events).collect()) == [1, 2]
