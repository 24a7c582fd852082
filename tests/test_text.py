from pyspark.sql import functions as F

from refweave.functions import text as T


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values.items()))
    return df.select(expr.alias("x")).first().x


def test_ngrams_are_padded(spark):
    assert one(spark, T.ngrams(F.col("s"), 3), s="Ab") == ["__a", "_ab", "ab_", "b__"]
    assert one(spark, T.ngrams(F.col("s"), 3), s="") == []
    assert one(spark, T.ngrams(F.col("s"), 3), s=None) == []


def test_neighbouring_years_share_a_token(spark):
    pairs = lambda y: one(spark, F.array(*T.year_pairs(F.col("y"), 2027)), y=y)
    assert pairs(2001) == [20002001, 20012002]
    assert set(pairs(2001)) & set(pairs(2002)) == {20012002}
    assert not set(pairs(2001)) & set(pairs(2003))
    assert pairs(2500) == [None, None]


def test_bundle_sorts_nulls_last(spark):
    df = spark.createDataFrame([("b", None, "a", "b")], "p string, q string, r string, s string")
    assert df.select(T.bundle(*[F.col(c) for c in "pqrs"]).alias("x")).first().x == ["a", "b", None, None]


def test_ascii_fold(spark):
    assert one(spark, T.ascii_fold(F.col("s")), s="Großmüller & Ægir «é»") == "Grossmuller & AEgir <<e>>"
    assert one(spark, T.ascii_fold(F.col("s")), s=None) is None


def test_clean_int_needs_its_bounds(spark):
    df = spark.createDataFrame([("10", None), ("10", "5"), ("3", "5"), ("x", "5")], "start string, stop string")
    got = [r.x for r in df.select(T.clean_int(F.col("start"), F.lit(1), F.col("stop").cast("long")).alias("x")).collect()]
    assert got == [None, None, 3, None]


def test_wordgrams_have_no_padding(spark):
    assert one(spark, T.wordgrams(F.col("s"), 2), s="Zwei rote Äpfel") == ["zwei_rote", "rote_äpfel"]
    assert one(spark, T.wordgrams(F.col("s"), 4), s="zu kurz") == []


def test_set_similarities(spark):
    df = spark.createDataFrame([(2, 4, 3)], "i int, a int, b int")
    got = df.select(*[T.similarity(k, F.col("i"), F.col("a"), F.col("b")).alias(k) for k in ("jaccard", "dice", "overlap", "cosine")]).first()
    assert [round(x, 4) for x in got] == [0.4, 0.5714, 0.6667, 0.5774]


def test_folding_of_window_signs_only(spark):
    df = spark.createDataFrame([("\u0085caf\u00e9\u0085",)], "v string")
    row = df.select(T.ascii_fold(F.col("v"), windows_only=True).alias("w"), T.ascii_fold(F.col("v")).alias("a")).first()
    assert "\u00e9" in row.w and "\u0085" not in row.w and "\u00e9" not in row.a
