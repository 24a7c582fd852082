"""Pairwise and mapping-based evaluation of a labelling against gold groups.

All measures come from group sizes, so that no pair is ever formed. Rows with a
null gold value take no part unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.sources.tables import cut


def _squares(df: DataFrame, keys: list[str], name: str, count: Column | None = None) -> DataFrame:
    n = F.count("*") if count is None else count
    return df.groupBy(*keys).agg(n.alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias(name))


def pair_counts(df: DataFrame, gold: str = "gold", auto: str = "auto") -> DataFrame:
    """One row (t, p, tp): squared sizes of gold groups, labels and their meets."""
    rows = df.where(F.col(gold).isNotNull() & F.col(auto).isNotNull()).select(F.col(gold).alias("g"), F.col(auto).alias("a"))
    return _squares(rows, ["g"], "t").crossJoin(_squares(rows, ["a"], "p")).crossJoin(_squares(rows, ["g", "a"], "tp"))


def pair_prf(df: DataFrame, gold: str = "gold", auto: str = "auto") -> DataFrame:
    """Precision, recall and F as rounded percent, half to even."""
    counts = pair_counts(df, gold, auto)
    p, r = 100.0 * F.col("tp") / F.nullif(F.col("p"), F.lit(0)), 100.0 * F.col("tp") / F.nullif(F.col("t"), F.lit(0))
    return counts.select(F.bround(p, 0).alias("precision"), F.bround(r, 0).alias("recall"), F.bround(2 * p * r / (p + r), 0).alias("f1"))


def ratios(df: DataFrame, gold: str = "gold", auto: str = "auto") -> DataFrame:
    """Unrounded precision, recall, F1; all 1 where there is nothing to compare."""
    c = pair_counts(df, gold, auto)
    nothing = (F.col("p") == 0) | (F.col("t") == 0)
    p, r = F.col("tp") / F.col("p"), F.col("tp") / F.col("t")
    return c.select(*[F.when(nothing, 1.0).otherwise(F.round(x, 6)).alias(n) for n, x in (("precision", p), ("recall", r), ("f1", 2 * p * r / (p + r)))])


def capped_counts(df: DataFrame, label_sizes: DataFrame, max_label: int, max_gold: int) -> DataFrame:
    """Pair counts where labels of more than max_label representations fall back to the representation as label.

    df: (gold, label, rep); label_sizes: (label, reps). Gold groups above max_gold are left out.
    """
    rows = df.where("gold is not null and label is not null and rep is not null")
    big = label_sizes.where(F.col("reps") > max_label).select("label").withColumn("big", F.lit(True))
    kept = rows.groupBy("gold").count().where(F.col("count") <= max_gold).select("gold")
    rows = rows.join(kept, "gold").join(big, "label", "left")
    rows = cut(rows.select("gold", F.when(F.col("big"), F.concat(F.lit("r"), F.col("rep"))).otherwise(F.concat(F.lit("l"), F.col("label").cast("string"))).alias("auto")))
    return pair_counts(rows)


def minimal_recall(rows: DataFrame, under: DataFrame) -> DataFrame:
    """One row (tp, t, p, micro_recall, macro_recall, micro_precision) of blocking by minimal elements.

    rows: (gold, rep, freq); under: (rep, minel), a minimal set under itself. Two mentions meet where their sets share a
    minimal set. Pairs that share several are counted once by inclusion and exclusion over the combinations of a set's
    minimal sets, which are few as it has few features; no pair is formed. Values without a pair are null.
    """
    freqs = rows.where("gold is not null and rep is not null").groupBy("gold", "rep").agg(F.sum("freq").alias("freq"))
    minels = under.groupBy("rep").agg(F.array_sort(F.collect_set("minel")).alias("minels"))
    freqs = cut(freqs.join(minels, "rep").groupBy("gold", "minels").agg(F.sum("freq").alias("freq")))
    number = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("minels")) - 1).cast("int"))
    chosen = lambda mask: F.filter("minels", lambda _, i: F.floor(mask / F.pow(F.lit(2), i)) % 2 == 1)
    parts = freqs.select("gold", "freq", F.explode(F.transform(number, chosen)).alias("part"))
    sign = F.when(F.size("part") % 2 == 1, 1.0).otherwise(-1.0)
    met = lambda *keys: parts.groupBy(*keys, "part").agg(F.sum("freq").alias("n")).withColumn("n", sign * F.col("n") * F.col("n"))
    per = freqs.groupBy("gold").agg((F.sum("freq") * F.sum("freq")).alias("t")).join(met("gold").groupBy("gold").agg(F.sum("n").alias("tp")), "gold")
    recall = F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(0.0)
    found = per.agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.avg(recall).alias("macro_recall")).crossJoin(met().agg(F.sum("n").alias("p")))
    share = lambda whole: F.col("tp") / F.nullif(F.col(whole), F.lit(0))
    return found.select("tp", "t", "p", share("t").alias("micro_recall"), "macro_recall", share("p").alias("micro_precision"))


def truncated_percent(part: Column, whole: Column) -> Column:
    """100 part / whole cut, not rounded, after two digits."""
    return F.floor(10000 * part / F.nullif(whole, F.lit(0))) / 100


def core_evaluation(df: DataFrame) -> DataFrame:
    """One row (tp, fp, tn, fn) over mentions (mention, gold, label).

    A mention with label mates is right if they include all its gold mates; one
    without is right if it has no gold mates either.
    """
    rows = df.where("gold is not null and label is not null").select("mention", "gold", "label").distinct()
    both = rows.groupBy("gold", "label").agg(F.count("*").alias("gl"))
    g, lab = both.groupBy("gold").agg(F.sum("gl").alias("g")), both.groupBy("label").agg(F.sum("gl").alias("l"))
    n = both.join(g, "gold").join(lab, "label")
    some = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("gl"))), F.lit(0))
    return n.agg(
        some((F.col("l") > 1) & (F.col("gl") == F.col("g"))).alias("tp"), some((F.col("l") > 1) & (F.col("gl") < F.col("g"))).alias("fp"),
        some((F.col("l") == 1) & (F.col("g") == 1)).alias("tn"), some((F.col("l") == 1) & (F.col("g") > 1)).alias("fn"),
    )


def size_boundaries(df: DataFrame, key: str) -> DataFrame:
    """(size, groups, up_to): how many groups have each size, and the running number up to it."""
    from pyspark.sql import Window

    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))
    return sizes.withColumn("up_to", F.sum("groups").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def upper_median(df: DataFrame, key: str) -> DataFrame:
    """One row (avg_size, median_size): the element at half the number of sorted group sizes.

    Found in the histogram of sizes, which is as small as sizes are few.
    """
    b = size_boundaries(df, key)
    whole = b.agg(F.sum("groups").alias("k"), F.sum(F.col("size") * F.col("groups")).alias("rows"))
    at = b.crossJoin(whole).where(F.col("up_to") > F.floor(F.col("k") / 2))
    return at.agg(F.min("size").alias("median_size"), F.round(F.first(F.col("rows") / F.col("k")), 6).alias("avg_size"))


def gini(df: DataFrame, key: str) -> DataFrame:
    """One row (gini): inequality of group sizes, from their histogram."""
    from pyspark.sql import Window

    h = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Ranks of the c groups of one size are up_to - c + 1 .. up_to.
    ranks = F.col("c") * (2 * F.col("u") - F.col("c") + 1) / 2
    t = h.withColumn("u", upto).agg(F.sum(ranks * F.col("size")).alias("rx"), F.sum(F.col("c") * F.col("size")).alias("x"), F.sum("c").alias("n"))
    return t.select(F.round(2 * F.col("rx") / (F.col("n") * F.col("x")) - (F.col("n") + 1) / F.col("n"), 6).alias("gini"))


def negative_class(counts: DataFrame) -> DataFrame:
    """(precision, recall) of the mentions without duplicates, in truncated percent, from ``core_evaluation``."""
    return counts.select(truncated_percent(F.col("tn"), F.col("tn") + F.col("fn")).alias("precision"), truncated_percent(F.col("tn"), F.col("tn") + F.col("fp")).alias("recall"))


def weighted_gini(df: DataFrame) -> DataFrame:
    """One row (gini): inequality of x where each counts with a weight, from (x, weight).

    Equal values are added up first; what remains is as small as values are few.
    """
    from pyspark.sql import Window

    h = df.where("x is not null and weight is not null").groupBy("x").agg(F.sum("weight").cast("double").alias("w"))
    before = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = h.select("x", "w", F.sum("w").over(before).alias("w0"), F.sum(F.col("x") * F.col("w")).over(before).alias("xw0"), F.sum("w").over(upto).alias("w1"), F.sum(F.col("x") * F.col("w")).over(upto).alias("xw1"))
    area = F.sum(F.col("xw1") * F.col("w0") - F.col("xw0") * F.col("w1"))
    return c.agg((area / (F.max("xw1") * F.max("w1"))).alias("gini")).select(F.round("gini", 6).alias("gini"))


def minimal_stats(pairs: DataFrame) -> DataFrame:
    """(minel, any, multi, single, prob): of the sets over a minimal one, how many lie over others too, from (minel, superset)."""
    per = pairs.groupBy("superset").agg(F.count("*").alias("k"))
    many = F.sum((F.col("k") > 1).cast("long"))
    return pairs.join(per, "superset").groupBy("minel").agg(F.count("*").alias("any"), many.alias("multi"), (F.count("*") - many).alias("single"), F.round(many / F.count("*"), 6).alias("prob"))


def pair_samples(rows: DataFrame, per_label: int = 1000, most_equal: int = 10_000, per_pair: int = 10, most_different: int = 10_000) -> DataFrame:
    """(a, b, equal): pairs of mentions of one label and of two, from (mention, label): a sampling operator.

    The first pairs of each label, and of each pair of labels, in the order of mentions and labels; a label or a pair of
    labels is taken while those before it have not filled the cap on all, so that the last may go over it.
    """
    from pyspark.sql import Window

    rows = rows.where("mention is not null and label is not null").distinct()
    sizes = cut(rows.groupBy("label").agg(F.count("*").alias("n")))
    # No label gives less than one pair, so that the first labels fill the cap: a bounded number each.
    first = sizes.where("n > 1").orderBy("label").limit(most_equal).withColumn("pairs", F.least(F.col("n") * (F.col("n") - 1) / 2, F.lit(per_label)))
    before = F.coalesce(F.sum("pairs").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = first.withColumn("before", before).where(F.col("before") < most_equal).select("label", "n")
    # Only the head of a label is ranked: within hashed shares first, so that no task sorts a whole heavy label.
    share = Window.partitionBy("label", F.pmod(F.xxhash64("mention"), F.lit(64))).orderBy("mention")
    head = max(per_label + 1, per_pair)
    few = rows.withColumn("r", F.row_number().over(share)).where(F.col("r") <= head).drop("r")
    ranked = cut(few.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("mention"))).where(F.col("r") <= head))
    own = ranked.join(taken, "label")
    x, y = own.alias("x"), own.alias("y")
    place = (F.col("x.r") - 1) * F.col("x.n") - (F.col("x.r") - 1) * F.col("x.r") / 2 + (F.col("y.r") - F.col("x.r") - 1)
    # A pair's place is at least that of the first with its left side, which bounds the left sides.
    early = x.where((F.col("x.r") - 1) * F.col("x.n") - (F.col("x.r") - 1) * F.col("x.r") / 2 < per_label)
    equal = early.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.r") < F.col("y.r")) & (place < per_label)).select(F.col("x.mention").alias("a"), F.col("y.mention").alias("b"), F.lit(True).alias("equal"))
    labels = sizes.orderBy("label").limit(most_different + 1).withColumn("i", F.row_number().over(Window.orderBy("label"))).withColumn("k", F.count("*").over(Window.partitionBy()))
    p, q = labels.alias("p"), labels.alias("q")
    left = p.where((F.col("p.i") - 1) * F.col("p.k") - (F.col("p.i") - 1) * F.col("p.i") / 2 < most_different)
    at = (F.col("p.i") - 1) * F.col("p.k") - (F.col("p.i") - 1) * F.col("p.i") / 2 + (F.col("q.i") - F.col("p.i") - 1)
    two = left.join(q, (F.col("p.i") < F.col("q.i")) & (at < most_different)).select(at.alias("at"), F.col("p.label").alias("l1"), F.col("q.label").alias("l2"), F.col("q.n").alias("n2"), F.least(F.col("p.n") * F.col("q.n"), F.lit(per_pair)).alias("pairs"))
    gone = F.coalesce(F.sum("pairs").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    two = two.withColumn("gone", gone).where(F.col("gone") < most_different)
    u, v = ranked.where(F.col("r") <= per_pair).alias("u"), ranked.where(F.col("r") <= per_pair).alias("v")
    met = two.join(u, F.col("l1") == F.col("u.label")).join(v, (F.col("l2") == F.col("v.label")) & ((F.col("u.r") - 1) * F.col("n2") + F.col("v.r") - 1 < per_pair))
    return equal.union(met.select(F.col("u.mention"), F.col("v.mention"), F.lit(False)))
