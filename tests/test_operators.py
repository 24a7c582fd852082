import random

import pytest
from pyspark.sql import functions as F

from refweave.operators import consolidate as C
from refweave.operators import evaluate as E
from refweave.operators import graph as G
from refweave.operators import relational as R
from refweave.operators import similarity as S
from refweave.operators.skew import heavy_keys, key_counts


def union_find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(random.Random(k).randrange(60), random.Random(k + 500).randrange(60)) for k in range(50)]])
def test_components_name_the_smallest_node(spark, edges):
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a bigint, b bigint")
    assert {r.node: r.component for r in G.components(df).collect()} == union_find(edges)


def sets(spark, **named):
    return spark.createDataFrame([(n, f) for n, fs in named.items() for f in fs], "rep string, f string")


def test_containment_and_minimal_sets(spark):
    f = sets(spark, a="x", b="xy", c="xyz", q="q")
    pairs = G.contained(f)
    assert {(r.sub, r.sup) for r in pairs.collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert {r.rep for r in G.minimal(f, pairs).collect()} == {"a", "q"}
    assert {(r.sub, r.sup) for r in G.hasse(pairs).collect()} == {("a", "b"), ("b", "c")}
    blocks = {r.rep: r.block for r in G.poset_blocks(f).collect()}
    assert len({blocks[x] for x in "abc"}) == 1 and blocks["q"] != blocks["a"]


def test_a_superset_bridges_two_minimal_sets(spark):
    f = sets(spark, a="x", b="y", c="xy")
    assert len({r.block for r in G.poset_blocks(f).collect()}) == 1


def test_order_helpers(spark):
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "sub string, sup string")
    assert {(r.sub, r.sup) for r in G.closure(chain).collect()} == {("a", "b"), ("b", "c"), ("a", "c")}
    assert {(r.sub, r.sup) for r in G.reduction(chain).collect()} == {("a", "b"), ("b", "c")}
    assert {r.node: r.level for r in G.levels(chain).collect()} == {"a": 0, "b": 1, "c": 2}


def test_pair_counts(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2), (None, 2)], "gold int, auto int")
    c = E.pair_counts(df).first()
    assert (c.t, c.p, c.tp) == (8, 10, 6)
    p = E.pair_prf(df).first()
    assert (p.precision, p.recall) == (60, 75)
    same = E.pair_prf(df.select("gold", F.col("gold").alias("auto"))).first()
    assert (same.precision, same.recall, same.f1) == (100, 100, 100)


def test_percent_is_cut_not_rounded(spark):
    df = spark.createDataFrame([(2, 3)], "a int, b int")
    assert float(df.select(E.truncated_percent(F.col("a"), F.col("b")).alias("x")).first().x) == 66.66


def test_majority_vote_lets_null_stand_for_any(spark):
    df = spark.createDataFrame([("g", 1, None, 1), ("g", 1, 2, 2), ("g", 1, 2, 3), ("g", 1, 3, 4)], "grp string, a int, b int, k int")
    got = C.majority_vote(df, ["a", "b"], "k").first()
    assert (got.a, got.b, got.support) == (1, 2, 3)


def test_except_then_intersect(spark):
    s = lambda *x: spark.createDataFrame([(i,) for i in x], "x int")
    assert {r.x for r in R.except_then_intersect(s(1, 2, 3), s(2), s(1)).collect()} == {1}


def test_write_back_and_reset(spark):
    docs = spark.createDataFrame([(1, 2000), (2, None), (3, 5)], "id int, year int")
    new = spark.createDataFrame([(1, 2001), (2, 1999)], "id int, year int")
    both = C.write_back(docs, new, "id", ["year"])
    assert {(r.id, r.year, r.year_original) for r in both.collect()} == {(1, 2001, 2000), (2, 1999, None), (3, 5, 5)}
    assert {tuple(r) for r in C.reset(both, ["year"]).collect()} == {tuple(r) for r in docs.collect()}


def test_hamming_pairs_against_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.randrange(256) for _ in range(8)] for _ in range(6)]
    prints = [[b ^ (1 << rng.randrange(8)) if rng.random() < 0.6 else b for b in rng.choice(base)] for _ in range(40)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(prints)], "rec int, " + ", ".join(f"b{i} int" for i in range(8)))
    apart = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(a, b, strict=True))
    least = {tuple(p): i for i, p in reversed(list(enumerate(prints)))}
    want = {(i, j) for p, i in least.items() for q, j in least.items() if i < j and apart(p, q) <= 7} | {(least[tuple(p)], i) for i, p in enumerate(prints) if least[tuple(p)] < i}
    assert {(r.a, r.b) for r in S.hamming_pairs(df, 7).collect()} == want


def test_score_of_nothing_shared_in_weighted_types(spark):
    df = spark.createDataFrame([("g", 1, "matchID", "x"), ("g", 2, "matchID", "x"), ("g", 3, "title", "y")], "grp string, rec int, ftype string, value string")
    got = S.pair_scores(df).collect()
    assert [(r.a, r.b, round(r.score, 4)) for r in got] == [(1, 2, 0.0038)]
    assert len({r.cluster for r in S.logistic_clusters(df).collect()}) == 3


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_key_counts_with_a_hot_key(spark, partitions):
    rng = random.Random(partitions)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}", rng.randrange(50) if rng.random() < 0.95 else None) for _ in range(3000)] + [(None, 1), ("alone", None)]
    df = spark.createDataFrame(rows, "k string, i bigint")
    want = {}
    for k, i in rows:
        if k is not None:
            n, items = want.get(k, (0, frozenset()))
            want[k] = (n + 1, items | ({i} if i is not None else set()))
    got = {r.key: (r.rows, r.items) for r in key_counts(df, F.col("k"), F.col("i"), partitions).collect()}
    assert got == {k: (n, len(s)) for k, (n, s) in want.items()}
    assert {r.key for r in heavy_keys(df, F.col("k"), F.col("i"), 0.9).collect()} <= {"hot"} | set(want)


def test_key_counts_without_reuse_of_exchanges(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = [("hot", i % 700) for i in range(2000)] + [(f"k{i % 150}", i % 11) for i in range(2000)]
        got = {r.key: (r.rows, r["items"]) for r in key_counts(spark.createDataFrame(rows, "key string, item long"), F.col("key"), F.col("item"), 7).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    want = {}
    for k, i in rows:
        want.setdefault(k, []).append(i)
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()}


def test_key_counts_of_nothing(spark):
    df = spark.createDataFrame([], "k string, i bigint")
    assert key_counts(df, F.col("k"), F.col("i"), 3).collect() == []


def test_dense_numbers_and_first_wins(spark):
    df = spark.createDataFrame([(x,) for x in "dbca"], "x string")
    assert {r.x: r.n for r in R.dense_numbers(df, "x", "n").collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}
    rows = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early"), ("j", 5, "only")], "k string, t int, v string")
    assert {(r.k, r.v) for r in R.first_wins(rows, ["k"], [F.col("t")]).collect()} == {("k", "early"), ("j", "only")}
