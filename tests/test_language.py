from refweave.operators import language as L


def test_long_words_are_corrected_over_more_than_two_edits(spark):
    vocabulary = spark.createDataFrame([("staatlichkeit", 30), ("gewerkschaftliche", 20), ("kind", 50), ("bundesrepublikanische", 20)], "term string, freq bigint")
    want = {"staatlichkeitund": "staatlichkeit", "undgewerkschaftliche": "gewerkschaftliche", "bxndesrxpublikxnischxe": "bundesrepublikanische", "bxndesrxpxblikxnischxe": "bxndesrxpxblikxnischxe", "kindx": "kind", "kindxx": "kindxx"}
    got = L.corrected(spark.createDataFrame([(w,) for w in want], "word string"), vocabulary)
    assert {r.word: r.correction for r in got.collect()} == want
