"""Vocabulary and whitespace models from counts over all texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refweave.functions.text import ascii_fold
from refweave.sources.tables import cut

DELTA, MERGE_ABOVE = 0.75, 2.0


def whitespace_contexts(texts: Column, n: int = 4) -> Column:
    """(across, h, w) at every place between two words and inside every word: the n characters on either side."""
    words = F.filter(F.split(F.lower(texts), r"\s+"), lambda t: F.length(t) > 0)
    ends = lambda h, w: (F.substring(h, F.greatest(F.lit(1), F.length(h) - (n - 1)), F.lit(n)), F.substring(w, F.lit(1), F.lit(n)))

    def context(across: bool, h: Column, w: Column) -> Column:
        left, right = ends(h, w)
        return F.struct(F.lit(across).alias("across"), left.alias("h"), right.alias("w"))

    none = F.array().cast("array<struct<across:boolean,h:string,w:string>>")
    between = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: context(True, F.get(words, i - 1), F.get(words, i)))).otherwise(none)
    inside = F.flatten(F.transform(words, lambda t: F.when(F.length(t) > 1, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: context(False, F.substring(t, F.lit(1), i), F.substring(t, i + 1, F.length(t))))).otherwise(none)))
    return F.concat(between, inside)


def context_counts(df: DataFrame, text: str, n: int = 4) -> DataFrame:
    """(across, h, w, n): how often each context occurs."""
    return df.select(F.explode(whitespace_contexts(F.col(text), n)).alias("c")).groupBy("c.across", "c.h", "c.w").agg(F.count("*").alias("n"))


def discounted(counts: DataFrame, delta: float = DELTA) -> DataFrame:
    """(across, h, w, p): absolute discounting with continuation counts, for the contexts that occur."""
    counts = cut(counts)
    history = counts.groupBy("across", "h").agg(F.sum("n").alias("f_h"), F.count("*").alias("d_w"))
    word = counts.groupBy("across", "w").agg(F.count("*").alias("d_h"))
    total = counts.groupBy("across").agg(F.count("*").alias("all"))
    c = counts.join(history, ["across", "h"]).join(word, ["across", "w"]).join(total, "across")
    p = F.greatest(F.lit(0.0), F.col("n") - delta) / F.col("f_h") + delta / F.col("f_h") * F.col("d_w") * F.col("d_h") / F.col("all")
    return c.select("across", "h", "w", p.alias("p"))


def merge_scores(counts: DataFrame, delta: float = DELTA) -> DataFrame:
    """(h, w, score): probability inside a word over that across words, for contexts seen both ways; above 2 the parts are one word."""
    p = cut(discounted(counts, delta))
    inside = p.where("not across").select("h", "w", F.col("p").alias("within"))
    return inside.join(p.where("across").select("h", "w", F.col("p").alias("between")), ["h", "w"]).select("h", "w", (F.col("within") / F.col("between")).alias("score"))


def deletions(word: Column, far: int) -> Column:
    """The word and all forms with up to ``far`` characters left out (far 1 or 2)."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    forms = F.concat(F.array(word), once(word))
    return F.array_distinct(F.concat(forms, F.flatten(F.transform(once(word), once))) if far > 1 else forms)


def corrected(words: DataFrame, vocabulary: DataFrame, ratio: float = 0.2, most: int = 4) -> DataFrame:
    """(word, correction): the closest, then most frequent vocabulary term within min(most, ratio * length) edits, else the word.

    words: (word); vocabulary: (term, freq). For up to two edits candidates meet on forms with characters left out. For
    k > 2 a word is cut into k + 1 pieces, one of which no edit touches: it stands in the term, at most k places off.
    """
    words = cut(words.select("word").distinct().withColumn("allowed", F.least(F.lit(most), F.floor(F.length("word") * ratio)).cast("int")))
    near = min(most, 2)
    left = words.where((F.col("allowed") >= 1) & (F.col("allowed") <= near)).withColumn("form", F.explode(deletions(F.col("word"), near)))
    right = vocabulary.withColumn("form", F.explode(deletions(F.col("term"), near)))
    # Merge joins: the files of words and terms tell too little of what their forms take in the driver's memory.
    met = left.join(right.hint("merge"), "form").select("word", "allowed", "term", "freq")
    if most > 2:
        # The shortest word with three edits has the shortest pieces; six letters are enough to look up.
        least, longest = max(1, min(6, int(3 / ratio) // 4)), 6
        size = F.least(F.lit(longest), F.greatest(F.lit(1), F.floor(F.length("word") / (F.col("allowed") + 1)))).cast("int")
        at = words.where("allowed > 2").withColumn("size", size).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("allowed"))))
        pieces = at.withColumn("x", (F.col("i") * F.floor(F.length("word") / (F.col("allowed") + 1)) + 1).cast("int")).withColumn("form", F.substring("word", F.col("x"), F.col("size")))
        long = vocabulary.where(F.length("term") >= least).withColumn("size", F.explode(F.sequence(F.lit(least), F.least(F.lit(longest), F.length("term")))))
        parts = long.withColumn("y", F.explode(F.sequence(F.lit(1), F.length("term") - F.col("size") + 1))).withColumn("form", F.substring("term", F.col("y"), F.col("size"))).drop("size")
        fits = (F.abs(F.col("x") - F.col("y")) <= F.col("allowed")) & (F.abs(F.length("word") - F.length("term")) <= F.col("allowed"))
        met = met.union(pieces.join(parts.hint("merge"), "form").where(fits).select("word", "allowed", "term", "freq"))
    met = met.distinct().withColumn("away", F.levenshtein("word", "term")).where(F.col("away") <= F.col("allowed"))
    best = met.groupBy("word").agg(F.min_by("term", F.struct("away", (-F.col("freq")).alias("f"), "term")).alias("term"))
    return words.join(best, "word", "left").select("word", F.coalesce("term", "word").alias("correction"))


def language_votes(text: Column, stopwords: dict[str, list[str]]) -> Column:
    """The language most of whose function words occur; ``default`` where none does."""
    own = F.split(F.lower(text), r"[^\p{L}]+")
    among = lambda known: F.size(F.filter(own, lambda w: w.isin(*known)))
    votes = [F.struct(among(known).alias("n"), F.lit(code).alias("code")) for code, known in sorted(stopwords.items())]
    top = F.array_max(F.array(*votes))
    return F.when(top["n"] > 0, top["code"]).otherwise("default")


def compounds(words: DataFrame, vocabulary: DataFrame, least: int = 4, max_rounds: int = 50) -> DataFrame:
    """(word, parts): a word as vocabulary terms one after another, a linking s after a part allowed; the longest first part wins.

    A split goes on with what is left of the word until all of it is vocabulary, and a first part counts only where the
    rest can be split to its end; a rest that is a term isn't split again. A word that can't be split gives no row.
    """
    terms = cut(vocabulary.select("term").distinct().where(F.length("term") >= least))
    # Every way on from a rest: a term at its beginning, and what follows, with and without a linking s.
    rests = words.select(F.col("word").alias("rest")).distinct()
    steps = None
    for _ in range(max_rounds):
        at = rests.where(F.length("rest") > least).select("rest", F.explode(F.sequence(F.lit(least), F.length("rest") - 1)).alias("i"))
        heads = at.select("rest", F.substring("rest", F.lit(1), F.col("i")).alias("head"), F.substring("rest", F.col("i") + 1, F.length("rest")).alias("next"))
        ways = F.explode(F.array_distinct(F.array(F.col("next"), F.regexp_replace("next", "^s(?=.)", ""))))
        found = cut(heads.join(terms.withColumnRenamed("term", "head"), "head").select("rest", "head", ways.alias("next")).where(F.length("next") >= least))
        steps = found if steps is None else cut(steps.union(found))
        rests = cut(found.select(F.col("next").alias("rest")).distinct().join(steps.select("rest"), "rest", "left_anti"))
        if rests.isEmpty():
            break
    else:
        raise ValueError("a word has more parts than max_rounds")
    # From the ends back: a rest that is a term is done; others take the longest head whose rest is done.
    done = terms.select(F.col("term").alias("rest"), F.array("term").alias("parts"))
    whole = None
    while True:
        ready = steps.join(done.withColumnRenamed("rest", "next"), "next").select("rest", F.concat(F.array("head"), "parts").alias("parts"))
        ready = ready if whole is None else ready.unionByName(whole)
        better = ready.groupBy("rest").agg(F.max_by("parts", F.struct(F.length(F.col("parts")[0]), (-F.size("parts")).alias("n"), "parts")).alias("parts"))
        known = cut(better)
        if whole is not None and known.join(whole, ["rest", "parts"], "left_anti").isEmpty():
            break
        whole = known
        done = terms.select(F.col("term").alias("rest"), F.array("term").alias("parts")).unionByName(known.join(terms.withColumnRenamed("term", "rest"), "rest", "left_anti"))
    return words.select("word").distinct().join(whole.withColumnRenamed("rest", "word"), "word").select("word", "parts")


def separations(df: DataFrame, text: str, counts: DataFrame, floor: float = 0.01) -> DataFrame:
    """Rows with ``corrected``: words put together where their ends are hardly ever parted.

    counts: those of ``context_counts`` over the corpus, with as many characters as its contexts have. The chance of a
    gap is that of its left and right side among gaps, over that and the chance of the same characters inside a word; two
    words are one where it is less than ``floor``.
    """
    n = int(counts.agg(F.max(F.length("h"))).first()[0] or 1)
    apart, within = counts.where("across"), counts.where("not across")
    left = apart.groupBy("h").agg(F.sum("n").alias("f_left"))
    right = apart.groupBy("w").agg(F.sum("n").alias("f_right"))
    s1, s2 = within.agg(F.sum("n")).first()[0] or 1, apart.agg(F.sum("n")).first()[0] or 1
    inside = within.select("h", "w", (F.col("n") / s1).alias("together"))
    both = apart.select("h", "w").join(left, "h").join(right, "w").join(inside, ["h", "w"], "left")
    chance = F.col("f_left") / s2 * (F.col("f_right") / s2)
    glued = cut(both.where(chance / (chance + F.coalesce("together", F.lit(0.0))) < floor).select("h", "w", F.lit(True).alias("glued")))
    words = F.filter(F.split(F.col(text), r"\s+"), lambda t: F.length(t) > 0)
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    each = rows.select("*", F.posexplode_outer(words).alias("_at", "_word")).withColumn("_before", F.get(words, F.col("_at") - 1))
    last = lambda c: F.substring(F.lower(c), F.greatest(F.lit(1), F.length(c) - (n - 1)), F.lit(n))
    joined = each.withColumns({"h": last(F.col("_before")), "w": F.substring(F.lower("_word"), 1, n)}).join(glued, ["h", "w"], "left")
    piece = F.struct("_at", F.when(F.col("_at").isNull() | (F.col("_at") == 0) | F.col("glued"), F.coalesce("_word", F.lit(""))).otherwise(F.concat(F.lit(" "), "_word")).alias("t"))
    text_of = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), "")
    return joined.groupBy("_row", *df.columns).agg(text_of.alias("corrected")).select(*df.columns, F.when(F.col(text).isNotNull(), F.col("corrected")).alias("corrected"))


def word_bigrams(df: DataFrame, key: str, text: str, vocabulary: DataFrame, stopwords: tuple[str, ...], lemma: DataFrame | None = None) -> DataFrame:
    """(key, terms): bigrams of the known words of each section of a text, then its unknown words, each once.

    Sections end at the marks between title and subtitle and at stopwords. A word that isn't in the vocabulary (term,
    freq) is read as the closest term, else as the terms it is made of, else it is unknown. lemma: (word, base) of words
    to put in their base form. A section of one word gives that word.
    """
    parts = F.split(F.lower(F.col(text)), r"\s*[:;.?!]+\s+|\s+[-\u2013\u2014]\s+")
    rows = df.select(key, F.posexplode(parts).alias("s", "part")).select(key, "s", F.posexplode(F.regexp_extract_all("part", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("i", "raw"))
    # Stopwords part sections: what follows the next one is another section.
    stops = F.sum(F.col("raw").isin(*stopwords).cast("int")).over(Window.partitionBy(key, "s").orderBy("i"))
    rows = rows.withColumn("part", stops).where(~F.col("raw").isin(*stopwords)).withColumn("word", ascii_fold(F.col("raw")))
    rows = cut(rows.select(key, "s", "part", "i", "word"))
    distinct = cut(rows.select("word").distinct())
    terms = cut(vocabulary.groupBy(ascii_fold(F.col("term")).alias("term")).agg(F.sum("freq").alias("freq")))
    known = distinct.join(terms.select(F.col("term").alias("word")), "word", "left_semi").select("word", F.array("word").alias("parts"))
    other = cut(distinct.join(known.select("word"), "word", "left_anti"))
    close = cut(corrected(other, terms).where("word <> correction").select("word", F.array("correction").alias("parts")))
    made = compounds(other.join(close.select("word"), "word", "left_anti"), terms)
    read = known.union(close).union(made)
    told = rows.join(read, "word", "left")
    each = told.select(key, "s", "part", "i", F.posexplode_outer(F.coalesce("parts", F.array("word"))).alias("j", "w"), F.col("parts").isNotNull().alias("known"))
    if lemma is not None:
        each = each.join(lemma.select(F.col("word").alias("w"), "base"), "w", "left").withColumn("w", F.when(F.col("known"), F.coalesce("base", "w")).otherwise(F.col("w"))).drop("base")
    order = F.struct("i", "j", "w")
    by_part = each.groupBy(key, "s", "part").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("known"), order))), lambda x: x["w"]).alias("ws"), F.array_sort(F.collect_list(F.when(~F.col("known"), order))).alias("un"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("ws") - 1), lambda i: F.concat_ws(" ", F.get("ws", i - 1), F.get("ws", i)))
    grams = F.when(F.size("ws") > 1, pairs).otherwise(F.col("ws"))
    whole = by_part.select(key, F.struct("s", "part", grams.alias("g"), F.transform("un", lambda x: x["w"]).alias("u")).alias("p")).groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    all_terms = F.concat(F.flatten(F.transform("ps", lambda p: p["g"])), F.flatten(F.transform("ps", lambda p: p["u"])))
    return whole.select(key, F.array_distinct(all_terms).alias("terms"))
