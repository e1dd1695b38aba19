"""Every llm query with an oracle gives its rows, on the smallest tables."""

import os
from pathlib import Path

import pytest

from graphloom.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    if hasattr(x, "__float__") and not isinstance(x, str):
        return round(float(x), 5)
    return str(x)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, duck, name):
    found = queries.queries()[name](spark, SF)
    wanted = duck.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = sorted(found.columns)
    a = sorted(repr([plain(r[c]) for c in columns]) for r in found.collect())
    order = [wanted.columns.index(c) for c in columns]
    assert a == sorted(repr([plain(r[k]) for k in order]) for r in wanted.fetchall())
