"""Best representative of each duplicate group (problem 3).

Token-level consensus: the distinct spellings of a field in a group are aligned
one after another, the most supported first, into columns of tokens; every
spelling votes in each column with its weight (its rows, by trust), and the
consensus is the column winners. Large groups are aligned in chunks whose
consensus lines, with their weights, are aligned in turn, so that no task holds
a whole group. A value is judged against the consensus of its group: a title is
cut off when it ends inside the consensus. Two results come of it:
``consensus_values`` emits the existing value closest to the consensus,
``survivors`` the most trusted, latest row whose value is usable.

Defined cases: rows without a reference row, null and blank values and
placeholders are unusable; a group of one usable value keeps it; ties go to the
smaller refid; repeated members count once; no usable value, no row.
"""

from __future__ import annotations


from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.llm.unify import compared
from refweave.sources.tables import cut

CHUNK = 200

# Fixed values, in compared form: what is written where nothing is known.
NO_TITLE = ("", "n a", "none", "null", "nan", "title", "title unknown", "unknown", "untitled", "no title", "o t", "ohne titel", "sans titre", "x")
NO_NAME = ("", "n a", "none", "null", "nan", "u a", "ders", "dies", "anonymous", "anon", "anonym", "o v", "et al", "n n", "hrsg", "ed", "eds", "unknown", "idem")
NO_SOURCE = ("", "n a", "none", "null", "nan", "a a o", "ibid", "ebd", "in", "unknown", "s n", "hrsg von", "o o", "s l")
# Pages, volumes, numbers and dates instead of a title, name or source.
NUMBERS_ONLY = r"^(?:(?:s|p|pp|bd|band|vol|volume|nr|no|h|heft|t|tome|jg|с|т|стр|том|№)? ?[0-9]+(?: [0-9]+)*)$"


def usable(field: str, value: Column, compared_value: Column) -> Column:
    """Whether a value is one of its field at all, apart from titles that are cut off."""
    if field == "year":
        return value.cast("long").between(1500, 2026)
    none = {"title": NO_TITLE, "a1sur": NO_NAME, "source": NO_SOURCE}[field]
    return value.isNotNull() & ~compared_value.isin(*none) & ~compared_value.rlike(NUMBERS_ONLY) & compared_value.rlike(r"\p{L}")


def _aligned(columns: list[dict], tokens: list[str], weight: float) -> list[dict]:
    """The columns after one more line: dynamic programming over columns and tokens.

    The ends that agree with what the columns hold are taken as they are, so
    that the quadratic part is only what differs.
    """
    voted = max((sum(c.values()) for c in columns), default=0.0)
    head, limit = 0, min(len(columns), len(tokens))
    while head < limit and tokens[head] in columns[head]:
        columns[head][tokens[head]] += weight
        head += 1
    tail = 0
    while tail < limit - head and tokens[-1 - tail] in columns[-1 - tail]:
        columns[-1 - tail][tokens[-1 - tail]] += weight
        tail += 1
    if head + tail == len(columns) == len(tokens):
        return columns
    end = len(columns) - tail
    return columns[:head] + _aligned_middle(columns[head:end], tokens[head : len(tokens) - tail], weight, voted) + columns[end:]


def _aligned_middle(columns: list[dict], tokens: list[str], weight: float, voted: float) -> list[dict]:
    n, m = len(columns), len(tokens)
    totals = [sum(c.values()) for c in columns]
    gain = [[0.0] * (m + 1) for _ in range(n + 1)]
    step = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            best, way = -1e18, 0
            if i and j:
                hit = columns[i - 1].get(tokens[j - 1], 0.0) / totals[i - 1]
                best, way = gain[i - 1][j - 1] + (2 * hit if hit else -0.6), 1
            if i and gain[i - 1][j] - 0.5 > best:
                best, way = gain[i - 1][j] - 0.5, 2
            if j and gain[i][j - 1] - 0.5 > best:
                best, way = gain[i][j - 1] - 0.5, 3
            gain[i][j], step[i][j] = best, way
    out = []
    i, j = n, m
    while i or j:
        way = step[i][j]
        column = columns[i - 1] if way != 3 else {"": voted}
        word = tokens[j - 1] if way != 2 else ""
        column[word] = column.get(word, 0.0) + weight
        out.append(column)
        i, j = i - (way != 3), j - (way != 2)
    return out[::-1]


def consensus_line(lines: list[tuple[str, float]]) -> str:
    """The consensus of weighted lines by progressive alignment, the heaviest first."""
    lines = sorted(lines, key=lambda x: (-x[1], -len(x[0]), x[0]))
    columns = [{t: lines[0][1]} for t in lines[0][0].split()]
    for text, weight in lines[1:]:
        columns = _aligned(columns, text.split(), weight)
    # A title that goes on has the say about its end: an empty cell counts half.
    winners = (max(c.items(), key=lambda x: (x[1] * (0.5 if not x[0] else 1.0), x[0]))[0] for c in columns)
    return " ".join(w for w in winners if w)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The consensus of each run of equal keys in sorted rows; a run may go on in the next batch."""
    names = ["duplicateid", "fieldname", "chunk"]
    key, held = None, []
    for batch in batches:
        out = []
        for *own, line, weight in zip(*(batch[c] for c in (*names, "line", "weight")), strict=True):
            if own != key:
                if held:
                    out.append((key[0], key[1], consensus_line(held), sum(w for _, w in held)))
                key, held = own, []
            held.append((line, weight))
        yield pd.DataFrame(out, columns=["duplicateid", "fieldname", "line", "weight"])
    if held:
        yield pd.DataFrame([(key[0], key[1], consensus_line(held), sum(w for _, w in held))], columns=["duplicateid", "fieldname", "line", "weight"])


def consensus(lines: DataFrame) -> DataFrame:
    """(duplicateid, fieldname, consensus) for weighted lines (duplicateid, fieldname, line, weight), one row per distinct line."""
    schema = "duplicateid string, fieldname string, line string, weight double"
    done = []
    lines = cut(lines.select("duplicateid", "fieldname", "line", F.col("weight").cast("double").alias("weight")))
    while True:
        sizes = lines.groupBy("duplicateid", "fieldname").count()
        single = sizes.where("count = 1").select("duplicateid", "fieldname")
        done.append(lines.join(single, ["duplicateid", "fieldname"], "left_semi"))
        rest = lines.join(sizes.where("count > 1"), ["duplicateid", "fieldname"])
        chunk = F.pmod(F.xxhash64("line"), F.greatest(F.lit(1), F.ceil(F.col("count") / CHUNK)))
        keys = ["duplicateid", "fieldname", "chunk"]
        rest = rest.select("duplicateid", "fieldname", chunk.alias("chunk"), "line", "weight").repartition(*keys).sortWithinPartitions(*keys)
        lines = cut(rest.mapInPandas(_chunks, schema))
        if lines.isEmpty():
            break
        sizes = lines.groupBy("duplicateid", "fieldname").count()
        if not sizes.where("count > 1").limit(1).count():
            done.append(lines)
            break
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.select("duplicateid", "fieldname", F.col("line").alias("consensus"))


def _member_values(refs: DataFrame, members: DataFrame, pipelines: DataFrame) -> DataFrame:
    """(duplicateid, refid, fieldname, value, line, ok, trust, extracted_at)."""
    own = members.select("duplicateid", "refid").where("duplicateid is not null and refid is not null").distinct()
    rows = own.join(refs.select("refid", "title", "year", "a1sur", "source", "frompipeline", "extracted_at"), "refid")
    trust = pipelines.groupBy(F.col("pipeline").alias("frompipeline")).agg(F.max("trust").alias("trust"))
    rows = rows.join(trust, "frompipeline", "left")

    def one(field: str) -> Column:
        value = F.col(field).cast("string")
        # A year is aligned digit by digit.
        line = compared(value) if field != "year" else F.trim(F.regexp_replace(value, "([0-9])", "$1 "))
        return F.struct(F.lit(field).alias("fieldname"), value.alias("value"), line.alias("line"))

    parts = rows.select("duplicateid", "refid", "trust", "extracted_at", F.explode(F.array(*[one(f) for f in ("title", "year", "a1sur", "source")])).alias("p"))
    parts = parts.select("duplicateid", "refid", "trust", "extracted_at", "p.fieldname", "p.value", "p.line")
    ok = F.lit(False)
    for f in ("title", "year", "a1sur", "source"):
        ok = F.when(F.col("fieldname") == f, F.coalesce(usable(f, F.col("value"), F.col("line")), F.lit(False))).otherwise(ok)
    return parts.withColumn("ok", ok)


def judged(refs: DataFrame, members: DataFrame, pipelines: DataFrame) -> DataFrame:
    """The usable values of every group, with ``consensus`` and ``usable``."""
    values = cut(_member_values(refs, members, pipelines).where("ok"))
    weight = F.sum(F.lit(1.0) + F.coalesce("trust", F.lit(0)) / 10)
    lines = values.groupBy("duplicateid", "fieldname", "line").agg(weight.alias("weight"))
    agreed = consensus(lines)
    both = values.join(agreed, ["duplicateid", "fieldname"], "left")
    return both.withColumn("usable", ~((F.col("fieldname") == "title") & cut_off(F.col("value"), F.col("line"), F.col("consensus"))))


def cut_off(value: Column, line: Column, consensus_text: Column) -> Column:
    """Whether a title ends before the consensus does: it is like the beginning of the consensus and unlike the whole."""
    n, whole = F.length(line), F.length(consensus_text)
    begins = F.call_function("levenshtein", line, F.substring(consensus_text, F.lit(1), n), F.floor(n * 0.15).cast("int")) >= 0
    # The end itself must be missing: the last words of the consensus are no part of the line.
    tail = F.substring(consensus_text, whole - 5, F.lit(6))
    shorter = (n <= whole - 2) & (F.substring(line, n - 5, F.lit(6)) != tail)
    far = F.levenshtein(F.substring(line, F.greatest(F.lit(1), n - 14), F.lit(15)), F.substring(consensus_text, F.greatest(F.lit(1), whole - 14), F.lit(15)), 9)
    broken = F.rtrim(value).rlike(r"[\p{L}]-$|…$|\.\.\.$|\[$")
    return F.coalesce(broken | (shorter & begins & ((far < 0) | (far > 5))), F.lit(False))


def survivors(refs: DataFrame, members: DataFrame, pipelines: DataFrame) -> DataFrame:
    """(duplicateid, fieldname, refid): the usable value of the highest trust, then the latest, then the smallest refid."""
    good = judged(refs, members, pipelines).where("usable")
    order = F.struct(F.coalesce("trust", F.lit(-1)).alias("trust"), F.col("extracted_at"), (-F.col("refid")).alias("neg"))
    return good.groupBy("duplicateid", "fieldname").agg(F.max(order).alias("best")).select("duplicateid", "fieldname", (-F.col("best.neg")).alias("refid"))


def consensus_values(refs: DataFrame, members: DataFrame, pipelines: DataFrame) -> DataFrame:
    """(duplicateid, fieldname, value, refid): the existing value closest to the consensus of its group and field."""
    values = judged(refs, members, pipelines)
    distance = F.levenshtein("line", "consensus")
    order = F.struct(distance.alias("distance"), (-F.coalesce("trust", F.lit(-1))).alias("trust"), "refid", "value")
    return values.groupBy("duplicateid", "fieldname").agg(F.min(order).alias("best")).select("duplicateid", "fieldname", "best.value", "best.refid")


