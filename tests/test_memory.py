"""Rows that a generator makes many of are not gathered in the driver."""

from pathlib import Path

import pytest

from refweave.operators import consolidate as C
from refweave.operators import language as L
from refweave.operators import similarity as S
from refweave.operators import train as M
from refweave.plans import linkage, models

DATA = Path("/root/testdata/sf0.001")


def broadcast(df):
    """The joins of a plan that send a table through the driver."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]


def test_grams_of_a_group_are_not_broadcast(spark):
    rows = [("g", 5, "Der Staat", 2.0), ("g", 3, "der staat", 2.0), ("g", 4, "Der Staat im Wandel", 1.0), ("g", 2, "", 9.0), ("h", 1, "Kind", 1.0)]
    got = C.best_representative(spark.createDataFrame(rows, "grp string, id long, value string, weight double"), 1.0)
    assert not [line for line in broadcast(got) if "gram#" in line]
    assert [tuple(r) for r in got.collect()] == [("g", 3)]


def test_blocks_of_prints_are_not_broadcast(spark):
    prints = spark.createDataFrame([(i, *[i * (j + 3) % 256 for j in range(8)]) for i in range(30)] + [(90, *[0] * 8)], "rec long, " + ", ".join(f"b{j} int" for j in range(8)))
    got = S.hamming_pairs(prints, 7)
    assert not broadcast(got)
    assert (0, 90, 0) in [tuple(r) for r in got.collect()]


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
def test_blocks_of_prints_are_looked_for_once(spark):
    assert "bit_count" not in linkage.gr15_simhash_blocks(spark, str(DATA))._jdf.queryExecution().sparkPlan().toString()


def test_words_of_a_record_meet_in_one_exchange(spark):
    words = spark.createDataFrame([(1, "der"), (1, "der"), (1, "staat"), (2, "staat")], "rec long, f string")
    plan = S.simhash(words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_forms_of_words_are_not_broadcast(spark):
    words = spark.createDataFrame([("kindx",), ("staatlichkeitund",)], "word string")
    got = L.corrected(words, spark.createDataFrame([("kind", 50), ("staatlichkeit", 30)], "term string, freq bigint"))
    assert not [line for line in broadcast(got) if "form#" in line]
    assert {tuple(r) for r in got.collect()} == {("kindx", "kind"), ("staatlichkeitund", "staatlichkeit")}


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
def test_features_of_labelled_pairs_are_not_moved(spark):
    got = models.gr30_training_vectors(spark, str(DATA))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "ftype" not in plan and "file:" + spark.sparkContext.getConf().get("spark.checkpoint.dir") not in plan
    assert {tuple(r) for r in got.select("a", "b").collect()} == {tuple(r) for r in linkage.gr5_pair_scores(spark, str(DATA)).join(got, ["a", "b"]).select("a", "b").collect()}


def test_vectors_of_pairs(spark):
    sets = spark.createDataFrame([("g", 1, [1, 2, 3], [7]), ("g", 2, [2, 3, 4], [8]), ("g", 3, [9], [5]), ("h", 1, [1, 2, 3], [7]), ("h", 2, [2, 3, 4], [8])], "grp string, rec long, title array<long>, source array<long>")
    groups = spark.createDataFrame([(1, "p"), (2, "p"), (2, "q"), (3, "p")], "rec long, group string")
    got = M.vectors(sets, groups).select("a", "b", "title", "source", "editor", "label").collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 0.5, 0.0, 0.0, 0.0), (1, 2, 0.5, 0.0, 0.0, 1.0)]
