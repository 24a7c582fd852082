"""Training the pair score on labelled similarity vectors."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.functions.text import similarity
from refweave.sources.tables import cut, drop

TYPES = ["title", "source", "pubnumber", "surname", "init", "first", "editor", "publisher"]


def vectors(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, <types>, label): similarities of the pairs of a block that share a value; label 1 where both are in one group (rec, group).

    sets: (grp, rec, <types>) with an array of hashes for each type. Where they are partitioned by ``grp``, the pairs are
    made without another exchange, and only what the vectors take is moved.
    """
    kinds = [c for c in sets.columns if c not in ("grp", "rec")]
    own = sets.groupBy("grp", "rec").agg(*[F.array_distinct(F.flatten(F.collect_list(t))).alias(t) for t in kinds])
    x, y = own.alias("x"), own.alias("y")
    met = x.join(y.hint("merge"), (F.col("x.grp") == F.col("y.grp")) & (F.col("x.rec") < F.col("y.rec")))
    counted = [F.struct(F.size(F.array_intersect(f"x.{t}", f"y.{t}")).alias("i"), F.size(f"x.{t}").alias("na"), F.size(f"y.{t}").alias("nb")).alias(t) for t in kinds]
    # Inside a generator, past which no filter is pushed, so that the sets are compared once.
    both = met.select(F.col("x.rec").alias("a"), F.col("y.rec").alias("b"), F.inline(F.array(F.struct(*counted)))).where(F.greatest(*[F.col(f"{t}.i") for t in kinds]) > 0)
    sim = lambda t: F.when(F.col(f"{t}.i") > 0, similarity("jaccard", F.col(f"{t}.i"), F.col(f"{t}.na"), F.col(f"{t}.nb"))).otherwise(0.0) if t in kinds else F.lit(0.0)
    sims = both.select("a", "b", *[sim(t).alias(t) for t in TYPES]).repartition("a").groupBy("a", "b").agg(*[F.max(t).alias(t) for t in TYPES])
    side = lambda s: groups.select(F.col("rec").alias(s), F.col("group").alias(f"g{s}"))
    return sims.join(side("a"), "a").join(side("b"), "b").select("a", "b", *TYPES, (F.col("ga") == F.col("gb")).cast("double").alias("label"))


def fitted(data: DataFrame):
    """The fitted logistic regression over all labelled pairs."""
    return LogisticRegression(maxIter=50, regParam=1e-4).fit(VectorAssembler(inputCols=TYPES, outputCol="features").transform(data))


def coefficients(data: DataFrame) -> DataFrame:
    """(ftype, weight) and the offset as ``bias``."""
    data = cut(data.select(*TYPES, "label"))
    model = fitted(data)
    drop(data)
    rows = [(t, float(w)) for t, w in zip(TYPES, model.coefficients, strict=True)] + [("bias", float(model.intercept))]
    return data.sparkSession.createDataFrame(rows, "ftype string, weight double")
