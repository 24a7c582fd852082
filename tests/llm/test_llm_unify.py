import unicodedata

import pytest
from pyspark.sql import functions as F

from refweave.llm import unify

CASES = [
    ("plain", "plain"), ("", ""), ("Ｍäｔａｎ　ｄ", "Mätan d"), ("été", "été"), ("soft­hyphen​", "softhyphen"), ("a‑b c", "a-b c"),
    ("ﬁsh oﬀ", "fish off"), ("Pаul", "Paul"), ("Томa", "Тома"), ("Иван Петров", "Иван Петров"), ("Kroll Kelvin", "Kroll Kelvin"),
    ("CO₂ R²", "CO₂ R²"), ("Straβe", "Straße"), ("й", "й"), ("Klouϲ̌iergby", "Kloučiergby"), ("1" * 50_000 + "​", "1" * 50_000),
]


@pytest.mark.parametrize(("raw", "plain"), CASES)
def test_consistent_form(spark, raw, plain):
    got = spark.createDataFrame([(raw,)], "v string").select(unify.consistent(F.col("v")).alias("x")).first().x
    assert got == plain
    assert unicodedata.normalize("NFC", got) == got


def test_null_stays_null_and_once_keeps_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "x​"), (2, "x​")], "k int, v string")
    assert [r.p for r in unify.once(df, ["k"], p=unify.consistent(F.col("v"))).orderBy("k").collect()] == [None, "x", "x"]


def test_canonical_values_with_clashing_columns(spark):
    rows = [(1, "Mül​ler", "p", "c"), (2, "Müller", "q", "d"), (3, "Müller", None, None), (4, None, "r", "e"), (4, "Muller", "r", "e")]
    df = spark.createDataFrame(rows, "key int, name string, plain string, canonical string")
    got = unify.canonical_values(unify.field_values(df, "key", ["name"])).collect()
    assert {(r.key, r.value, r.canonical) for r in got} == {(1, "Mül​ler", "Müller"), (2, "Müller", "Müller"), (3, "Müller", "Müller"), (4, "Muller", "Muller")}
    assert unify.canonical_values(unify.field_values(df.limit(0), "key", ["name"])).collect() == []


def test_nothing_of_a_long_value_is_lost(spark):
    raw = "caf" + "e\u0301" + " , \u0308" + "y" * 3000
    got = spark.createDataFrame([(raw,)], "v string").select(unify.consistent(F.col("v")).alias("x")).first().x
    assert got == unicodedata.normalize("NFC", raw) and len(got) == len(raw) - 1


def test_the_collation_alone_tells_values_equal(spark):
    # Neither the composed syllable nor the control character is in a table of look-alikes.
    rows = [(1, "\u1112\u1161\u11ab"), (2, "\ud55c"), (3, "Ku\u0001hn"), (4, "Kuhn"), (5, "K\u00fchn"), (6, "kuhn"), (7, "Ku\u0308hn")]
    got = unify.canonical_values(unify.field_values(spark.createDataFrame(rows, "key int, name string"), "key", ["name"])).collect()
    assert {r.key: r.canonical for r in got} == {1: "\ud55c", 2: "\ud55c", 3: "Kuhn", 4: "Kuhn", 5: "K\u00fchn", 6: "kuhn", 7: "K\u00fchn"}


def test_compared_form(spark):
    df = spark.createDataFrame([("Gefängnis,  Übel",), ("GEFAENGNIS; uebel",), ("Gefangnis Ubel",)], "v string")
    assert {r.x for r in df.select(unify.compared(F.col("v")).alias("x")).collect()} == {"gefangnis ubel"}
