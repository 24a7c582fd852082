"""Every llm query with SQL gives what the SQL gives, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from refweave.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got = queries.queries()[name](spark, str(DATA))
    names = sorted(got.columns)
    said = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in said.description]
    assert sorted(columns) == names
    shown = lambda rows, at: sorted(tuple(str(r[i]) for i in at) for r in rows)
    assert shown(got.collect(), names) == shown(said.fetchall(), [columns.index(c) for c in names])
