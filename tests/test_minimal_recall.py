from datetime import datetime

import pytest

from refweave.operators import evaluate as E
from refweave.plans import more


def test_minimal_recall_against_all_pairs(spark):
    rows = [(1, "a", 2.0), (1, "ab", 1.0), (1, "c", 4.0), (2, "abc", 3.0), (2, "b", 1.0), (3, "c", 5.0), (None, "a", 9.0)]
    under = {"a": "a", "b": "b", "c": "c", "ab": "ab", "abc": "abc"}
    got = E.minimal_recall(spark.createDataFrame(rows, "gold int, rep string, freq double"), spark.createDataFrame([(r, m) for r, ms in under.items() for m in ms], "rep string, minel string")).first()
    known = [r for r in rows if r[0] is not None]
    pairs = [(x, y, x[2] * y[2], bool(set(under[x[1]]) & set(under[y[1]]))) for x in known for y in known]
    t = {g: sum(n for x, y, n, _ in pairs if x[0] == y[0] == g) for g in (1, 2, 3)}
    tp = {g: sum(n for x, y, n, met in pairs if met and x[0] == y[0] == g) for g in t}
    p = sum(n for _, _, n, met in pairs if met)
    assert (got.tp, got.t, got.p) == (sum(tp.values()), sum(t.values()), p)
    assert got.micro_recall == pytest.approx(got.tp / got.t) and got.micro_precision == pytest.approx(got.tp / p)
    assert got.macro_recall == pytest.approx(sum(tp[g] / t[g] for g in t) / 3)


def test_gold_ids_meet_the_sets_of_their_references(spark, tmp_path):
    at = datetime(2020, 1, 1)
    spark.createDataFrame([(1, "l1", "Meier", 2000, None, at), (2, "l2", "Meier", 2000, "S", at), (3, "l3", "Kunz", 1990, None, at)], "refid bigint, linkid string, a1sur string, year bigint, source string, loaded_at timestamp").write.parquet(f"{tmp_path}/refmetas.parquet")
    spark.createDataFrame([(1, "l1", 7, 2.0), (2, "l2", 7, 1.0), (3, "l3", 7, 1.0)], "mentionid bigint, originalid string, goldid bigint, freq double").write.parquet(f"{tmp_path}/mentions.parquet")
    got = more.ag12_gold_recall(spark, str(tmp_path)).first()
    assert (got.tp, got.t, got.p, got.micro_precision) == (10, 16, 10, 1)
