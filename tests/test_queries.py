"""Every query with an oracle gives its rows, on the smallest tables."""

import os
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

import __spark_entry__
from graphloom.plans import index_queries, queries, store_queries

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


@pytest.fixture(scope="module")
def answers(spark, request):
    """Columns and rows of the chosen queries, several of which run at a time, as small tables leave most of the time to planning."""

    def answer(name):
        found = __spark_entry__.queries()[name](spark, SF)
        return found.columns, found.collect()

    names = [x.callspec.params["name"] for x in request.session.items if x.path == request.path and hasattr(x, "callspec")]
    pool = ThreadPoolExecutor(8)
    yield {name: pool.submit(answer, name) for name in names}
    pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql() | store_queries.oracle_sql() | index_queries.oracle_sql()))
def test_oracle(answers, duck, name):
    found, rows = answers[name].result()
    wanted = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(found) == sorted(wanted.columns)
    columns = sorted(found)
    a = sorted(repr([plain(r[c]) for c in columns]) for r in rows)
    order = [wanted.columns.index(c) for c in columns]
    b = sorted(repr([plain(r[k]) for k in order]) for r in wanted.fetchall())
    assert a == b


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
