"""Readers and writers beside Parquet."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(core_id, duplicate) from JSON lines {core_id, labelled_duplicates, doi}."""
    raw = spark.read.schema("core_id string, labelled_duplicates array<string>, doi string").json(path)
    return raw.select("core_id", F.explode_outer("labelled_duplicates").alias("duplicate"))


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(term, freq) from lines ``term count``."""
    return spark.read.csv(path, sep=" ", schema="term string, freq long")


def read_types(text: str) -> dict[str, list[str]]:
    """Feature type -> columns, from lines ``type:column column ...``."""
    return {t.strip(): cols.replace(",", " ").split() for t, _, cols in (line.partition(":") for line in text.splitlines()) if cols.strip()}


def read_disjunctions(text: str) -> list[list[str]]:
    """One rule of columns per line, of which one must be filled."""
    return [line.split() for line in text.splitlines() if line.split()]


def read_constraints(text: str) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """What feature types need and what they bar, from lines ``type sign other``; the sign - bars."""
    needs: dict[str, list[str]] = {}
    bars: dict[str, list[str]] = {}
    for own, sign, other in (line.split() for line in text.splitlines() if line.strip()):
        (bars if sign == "-" else needs).setdefault(own, []).append(other)
    return needs, bars


def nested_pairs(df: DataFrame, key: str) -> DataFrame:
    """(key, attr, value): every filled value of nested rows as text.

    A field of a struct goes by the names on its way, joined by underscores; a plain field bears an underscore in front;
    a list gives one pair an element, a list of structs one a field, under the list's name and the field's.
    """
    parts = []

    def fields(value: Column, name: str, own: str) -> Column:
        return F.transform(value, lambda x: F.struct(F.lit(f"{name}_{own}").alias("attr"), x[own].cast("string").alias("value")))

    def walk(value: Column, kind: T.DataType, name: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind:
                walk(value[f.name], f.dataType, f"{name}_{f.name}")
        elif isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.StructType):
                parts.extend(fields(value, name, f.name) for f in kind.elementType)
            else:
                parts.append(F.transform(value, lambda x: F.struct(F.lit(f"_{name}").alias("attr"), x.cast("string").alias("value"))))
        else:
            parts.append(F.array(F.struct(F.lit(f"_{name}").alias("attr"), value.cast("string").alias("value"))))

    for field in df.schema:
        if field.name != key:
            walk(F.col(field.name), field.dataType, field.name)
    none = F.array().cast("array<struct<attr:string,value:string>>")
    pairs = F.explode(F.concat(*[F.coalesce(p, none) for p in parts]))
    return df.select(key, pairs.alias("p")).select(key, "p.attr", "p.value").where("value is not null")


def read_config(folder: str) -> dict:
    """configs.json of a folder, overridden by configs_custom.json where there is one."""
    out: dict = {}
    for name in ("configs.json", "configs_custom.json"):
        p = Path(folder) / name
        if p.exists():
            out |= json.loads(p.read_text(encoding="utf-8"))
    return out


def flatten_documents(docs: DataFrame, arrays: list[str], key: str) -> DataFrame:
    """One row per reference of each array of structs: (key, pipeline, list_index, ref)."""
    out = None
    for a in arrays:
        one = docs.select(F.col(key), F.lit(a).alias("pipeline"), F.posexplode(a).alias("list_index", "ref"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def underspecified(*columns: str) -> Column:
    """Whether all columns of a rule are null."""
    return F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull()


def upsert(target: DataFrame, new: DataFrame, key: str, add: str) -> DataFrame:
    """Rows of both with the counts of equal keys summed."""
    return target.select(key, add).unionByName(new.select(key, add)).groupBy(key).agg(F.sum(add).alias(add))


def property_graph(nodes: DataFrame, edges: DataFrame, node: str, source: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, edge properties and node properties as long tables."""
    props = lambda df, keys: [c for c in df.columns if c not in keys]
    long = lambda df, keys: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("prop"), F.col(c).cast("string").alias("value"), F.lit(dict(df.dtypes)[c]).alias("type")) for c in props(df, keys)])).alias("p")).select(*keys, "p.*").where("value is not null")
    numbered = edges.withColumn("edge", F.sha1(F.concat_ws("|", source, target)))
    return numbered.select(source, "edge", target), long(numbered.drop(source, target), ["edge"]), long(nodes, [node])


def dot_lines(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Lines of a Graphviz file, one per edge; write with ``.write.text``."""
    return edges.select(F.format_string('"%s" -> "%s";', F.col(source).cast("string"), F.col(target).cast("string")).alias("value"))
