import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from refweave.llm import bagminhash as B
from refweave.llm import lowdiam, retrieve
from refweave.sources.tables import cut


def union_find(edges):
    """Node -> a common node of its group."""
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    return {x: root(x) for x in list(up)}


def weighted(x, y):
    shared = sum((x & y).values())
    return shared / max(1, x.total() + y.total() - shared)


def test_registers_agree_as_often_as_multisets_overlap():
    rng = random.Random(2)
    a = Counter({rng.randrange(10**9): rng.choice([1, 1, 2, 3, 7, 12]) for _ in range(300)})
    b = Counter({k: (v if rng.random() < 0.7 else rng.choice([1, 4, 9])) for k, v in a.items() if rng.random() < 0.85})
    doc = np.array([0] * len(a) + [1] * len(b))
    feature = B.mix(np.array([*a, *b], dtype=np.uint64))
    sig = B.signatures(doc, feature, np.array([*a.values(), *b.values()]), 2, registers=4096)
    assert np.isfinite(sig).all()
    assert abs((sig[0] == sig[1]).mean() - weighted(a, b)) < 0.03


def test_empty_records_have_no_signature():
    sig = B.signatures(np.array([1]), np.array([5], dtype=np.uint64), np.array([1]), 3, registers=8)
    assert not np.isfinite(sig[0]).any() and np.isfinite(sig[1]).all() and not np.isfinite(sig[2]).any()


@pytest.mark.parametrize(("features", "n", "threshold", "bag"), [("chars", 3, 0.7, False), ("words", 5, 0.8, True), ("chars", 3, 0.7, True)])
def test_similar_pairs_against_brute_force(spark, features, n, threshold, bag):
    rng = random.Random(n)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(60)]
    texts = []
    for _ in range(15):
        base = rng.choices(vocabulary, k=40)
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts = sorted({*texts, "ab", "", "abc abc"})
    cut = (lambda t: [t[i : i + n] for i in range(len(t) - n + 1)]) if features == "chars" else (lambda t: (lambda w: [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else [])(t.split()))
    bags = [Counter(cut(t)) if bag else Counter(set(cut(t))) for t in texts]
    want = {(i, j) for i, j in combinations(range(len(texts)), 2) if bags[i] and bags[j] and weighted(bags[i], bags[j]) >= threshold}
    got = {(r.a, r.b) for r in B.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), features, n, threshold, bag).collect()}
    assert got <= want
    assert len(got) >= 0.97 * len(want) and want


def test_similar_pairs_of_nothing(spark):
    assert B.similar_pairs(spark.createDataFrame([], "id bigint, text string")).collect() == []


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(25)], [(0, i) for i in range(1, 20)] + [(30, 31), (31, 30), (30, 31)]])
def test_low_diameter_groups(spark, edges):
    got = {r.node: r.component for r in lowdiam.components(spark.createDataFrame([*edges, (None, 5)], "a bigint, b bigint")).collect()}
    want = union_find(edges)
    assert set(got) == set(want)
    assert all((got[x] == got[y]) == (want[x] == want[y]) for x, y in combinations(want, 2))


@pytest.mark.parametrize("finish", [0, 10**6])
def test_low_diameter_groups_over_many_levels(spark, finish):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300) if i % 97] + [(rng.randrange(1000, 3000), rng.randrange(1000, 3000)) for _ in range(900)] + [(5000, i) for i in range(5001, 5400)]
    got = {r.node: r.component for r in lowdiam.components(spark.createDataFrame(edges, "a bigint, b bigint"), finish=finish).collect()}
    want = union_find(edges)
    assert set(got) == set(want)
    assert len(set(got.values())) == len(set(want.values())) == len({(got[x], want[x]) for x in want})


def test_groups_by_label_and_match(spark):
    labels = spark.createDataFrame([(5, 1, 0), (5, 2, 0), (3, 2, 0), (9, 7, 0), (None, 8, 0), (None, 8, 0)], "label bigint, repidindex bigint, component int")
    matches = spark.createDataFrame([(8, 7, 1), (1, 7, 0), (None, 1, 1), (7, None, 1), (2, 2, 1), (20, 1, 1), (7, 1, None)], "repidindex_a bigint, repidindex_b bigint, verdict bigint")
    assert {r.repidindex: r.groupid for r in lowdiam.groups(labels, matches).collect()} == {1: 3, 2: 3, 20: 3, 7: 9, 8: 9}


REFS = "refid bigint, title string, year bigint, a1sur string, a1first string, score double"
CATS = "catid bigint, title string, author string, year bigint, score double"
LONG = "The quantitative strike of literacy: ethnic evidence on property and language from Wesholm"


def test_rivals_that_fit_equally_are_not_matched(spark):
    refs = spark.createDataFrame([(1, LONG, None, "Miller", None, 0.0), (2, LONG, 2001, "Miller", None, 0.0), (3, LONG, 2001, "Ng", "Ng_Li", 0.0)], REFS)
    cats = spark.createDataFrame([(10, LONG, "Miller, Jane", 2001, 0.0), (11, LONG, "Miller, Jane", 2015, 0.0), (12, LONG, "Miller, Jane", 2015, 0.0)], CATS)
    assert {(r.refid, r.catid) for r in retrieve.matches(refs, cats).collect()} == {(2, 10), (3, 10)}


def test_matches_tell_works_apart(spark):
    refs = spark.createDataFrame(
        [
            (1, LONG, 2001, "Miller", None, 0.0), (2, LONG.upper().replace("STRIKE", "STRKE"), None, "Miller, J.", None, 0.0), (3, "Review of: " + LONG, 2001, "Miller", None, 0.0), (4, LONG, 2015, "Miller", None, 0.0),
            (5, None, 2001, "Miller", None, 0.0), (6, "[No title]", 2001, None, None, 0.0), (7, LONG + ". Volume 2", 2001, "Miller", None, 0.0), (8, "Something else entirely about harbours in winter", 2001, "Miller", None, 0.0), (1, LONG, 2001, "Miller", None, 0.0),
        ], REFS)
    cats = spark.createDataFrame([(10, LONG, "Miller, Jane", 2001, 0.0), (11, LONG + ". Vol. 2", "Miller, Jane", None, 0.0), (12, None, None, None, 0.0), (13, "Harbours", "Miller", 2001, 0.0)], CATS)
    got = {(r.refid, r.catid) for r in retrieve.matches(refs, cats).collect()}
    assert {(1, 10), (2, 10), (7, 11)} <= got
    assert not {r for r, _ in got} & {3, 4, 5, 6, 8}
    assert retrieve.matches(refs.limit(0), cats).collect() == []
    assert retrieve.matches(refs, cats.limit(0)).collect() == []


@pytest.mark.parametrize(("year", "other", "fit"), [(2001, 2001, 2), (2001, 2002, 1), (2001, 2010, -1), (None, 2001, 0), (2001, None, 0), (20012002, 2002, 1), (201, 2010, 1), (20194, 2019, 1), (0, 1999, 0), (99, 1999, 1)])
def test_year_fit(spark, year, other, fit):
    df = spark.createDataFrame([(year, other)], "y bigint, c bigint")
    assert df.select(retrieve.year_fit(F.col("y"), F.col("c")).alias("x")).first().x == fit


def test_the_fit_converges_on_kinds_that_are_far_apart():
    rng = np.random.default_rng(5)
    x = np.vstack((np.column_stack((np.ones(4000), np.ones(4000), rng.uniform(0.9, 1, 4000))), np.column_stack((rng.uniform(-0.3, 0, 33), np.ones(33), rng.uniform(0.5, 1, 33)))))
    y = np.concatenate((np.ones(4000), np.zeros(33)))
    beta = retrieve.logistic(x, y)
    p = 1 / (1 + np.exp(-(beta[0] + x @ beta[1:])))
    assert np.isfinite(beta).all() and np.abs(beta).max() < 100 and beta[1] > 0
    assert (p[:4000] > 0.9).all() and (p[4000:] < 0.5).all()
    shuffled = rng.permutation(len(x))
    assert retrieve.logistic(x[shuffled], y[shuffled]) == pytest.approx(beta, abs=1e-4)


def test_confidence_rises_with_the_gap(spark):
    rng = random.Random(9)
    rows = [(i, i, 1, True, True, 1.0, rng.uniform(0.8, 1), 1) for i in range(300)] + [(i, 1000 + i, 2, False, True, rng.uniform(-0.4, -0.1), rng.uniform(0.6, 1), 1) for i in range(40)]
    rows += [(5000 + k, 5000, 1, True, False, gap, 0.9, 1) for k, gap in enumerate((-0.2, 0.0, 0.1, 0.5, 1.0))]
    top = spark.createDataFrame(rows, "refid bigint, catid bigint, rank int, fits boolean, of_clear boolean, gap double, share double, mutual int")
    got = {r.refid: r.confidence for r in retrieve.confident(top).where("refid >= 5000").collect()}
    in_order = [got[5000 + k] for k in range(5)]
    assert in_order == sorted(in_order) and in_order[0] < 0.5 < in_order[-1] and len(set(in_order)) == 5


def test_title_pairs_against_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(25)]
    docs = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(80)]
    asked = [" ".join(w if rng.random() < 0.85 else rng.choice(words) for w in d.split()) for d in docs]
    runs = lambda t: {tuple(t.split()[i : i + 3]) for i in range(max(1, len(t.split()) - 2))}
    n = Counter(r for d in docs for r in runs(d))
    w = {r: np.log1p(len(docs) / (n[r] + 0.5)) for q in [*docs, *asked] for r in runs(q)}
    mass = lambda rs: sum(w[r] for r in rs)
    shared = {(i, j): mass(runs(q) & runs(d)) for i, q in enumerate(asked) for j, d in enumerate(docs)}
    best = {i: max(shared[i, j] for j in range(len(docs))) for i in range(len(asked))}
    want = {(i, j) for (i, j), x in shared.items() if x >= (retrieve.REST + retrieve.NEED) * min(mass(runs(asked[i])), mass(runs(docs[j]))) + 1e-4 and x >= retrieve.RIVAL * best[i]}
    frame = lambda ts: spark.createDataFrame(list(enumerate(ts)), "id bigint, title string")
    got = {(r.a, r.b) for r in retrieve.title_pairs(frame(asked), frame(docs)).collect()}
    assert want <= got and len(want) > 50


def test_every_pair_of_titles_that_shares_the_floor_is_found(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(25)]
    docs = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(120)]
    asked = [" ".join(w if rng.random() < 0.7 else rng.choice(words) for w in d.split()) for d in docs]
    docs += [f"{d} volume {i}" for i, d in enumerate(asked) if i % 3 == 0]
    runs = lambda t: {tuple(t.split()[i : i + 3]) for i in range(max(1, len(t.split()) - 2))}
    n = Counter(r for d in docs for r in runs(d))
    mass = lambda rs: sum(np.log1p(len(docs) / (n[r] + 0.5)) for r in rs)
    share = {(i, j): mass(runs(q) & runs(d)) / min(mass(runs(q)), mass(runs(d))) for i, q in enumerate(asked) for j, d in enumerate(docs)}
    frame = lambda ts: spark.createDataFrame(list(enumerate(ts)), "id bigint, title string")
    got = {(r.a, r.b) for r in retrieve.title_pairs(frame(asked), frame(docs)).collect()}
    want = {p for p, x in share.items() if x >= retrieve.FLOOR + 1e-4}
    assert want <= got and len(want) > 100
    assert all(share[p] >= retrieve.FLOOR - 1e-4 for p in got)


def test_another_volume_of_the_very_title_hides_no_record(spark):
    rng = random.Random(3)
    title = lambda: ["".join(rng.choices("abcdefghiklmnoprstuw", k=8)) for _ in range(12)]
    asked = title()
    spelled = [w + "x" if i in (3, 6, 7) else w for i, w in enumerate(asked)]
    cats = [(10, " ".join(spelled), "Miller, Jane", 2001, 0.0), (11, " ".join(asked) + " volume 2", "Miller, Jane", 2001, 0.0), *[(20 + i, " ".join(title()), "Ng, Li", 1990, 0.0) for i in range(50)]]
    refs = spark.createDataFrame([(1, " ".join(asked), 2001, "Miller", None, 0.0)], REFS)
    assert {(r.refid, r.catid) for r in retrieve.matches(refs, spark.createDataFrame(cats, CATS)).collect()} == {(1, 10)}


def test_only_pairs_that_may_share_the_floor_are_shuffled(spark):
    rng = random.Random(5)
    frame = lambda n: cut(spark.createDataFrame([(i, " ".join(rng.choices("abcdef", k=rng.randint(6, 10)))) for i in range(n)], "id bigint, title string"))
    asked, docs = frame(400), frame(400)
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def written():
        done = store.stageList(sc._jvm.java.util.ArrayList(), False, False, none, sc._jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteRecords() for s in map(done.apply, range(done.size()))}

    before = written()
    found = retrieve.title_pairs(asked, docs).count()
    pairs = max(n for stage, n in written().items() if stage not in before)
    assert 1000 < found <= pairs < 2 * found
