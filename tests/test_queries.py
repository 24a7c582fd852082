"""Every query with SQL gives what the SQL gives, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from refweave.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return repr(round(float(v), 6)) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA))
    names = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    said = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in said.description]
    assert sorted(columns) == names
    theirs = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in said.fetchall())
    assert mine == theirs


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry.__doc__
