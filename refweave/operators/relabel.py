"""Labelling the rows of each group by a function of the group."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relabel(df: DataFrame, group: str, to: str, label: Callable[[pd.DataFrame], pd.Series], most: int = 25_000) -> tuple[DataFrame, DataFrame]:
    """(rows with the column ``to``, groups left out with their sizes).

    label gets the rows of one group and gives one label a row; ``to`` is the group and the label with an underscore.
    Groups of more than ``most`` rows aren't handed to the function, as one task would hold them whole: their rows, and
    those without a group, keep null, and the second table lists these groups.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("size"))
    fit = df.join(sizes.where(F.col("size") <= most).select(group), group, "left_semi")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = label(rows)
        return rows.assign(**{to: [f"{g}_{x}" for g, x in zip(rows[group], own, strict=True)]})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{to}` string"])
    done = fit.groupBy(group).applyInPandas(run, schema)
    rest = df.join(sizes.where(F.col("size") <= most).select(group), group, "left_anti").select(*df.columns, F.lit(None).cast("string").alias(to))
    return done.unionByName(rest), sizes.where(F.col("size") > most)
