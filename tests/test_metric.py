"""The tree of balls gives what a scan gives, and skips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import metric, search


@pytest.fixture(scope="module")
def rows(spark):
    """Tight clusters, one of them of copies that outnumber all others, in two groups; vectors without angle or of another dimension."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    data = [(k, f"g{k % 2}", (centres[k % 12] + 0.05 * rng.normal(size=6)).tolist()) for k in range(240)]
    data += [(1000 + k, "g0", centres[3].tolist()) for k in range(200)]
    data += [(2000, "g0", [0.0] * 6), (2001, "g0", None), (2002, "g1", [1.0, 2.0]), (2003, "g2", [1.0, 0.0, 0.0]), (2004, "g3", None)]
    return spark.createDataFrame([(f"{k:05d}", g, v) for k, g, v in data], "node_id string, namespace string, vector array<double>")


def asked(rows):
    return rows.filter("cast(node_id as int) % 20 < 2 and node_id != '02004'").select(F.col("node_id").alias("query_id"), "vector", "namespace")


def key(df):
    return sorted((r.query_id, r["rank"] if "rank" in df.columns else 0, r.node_id, round(r.similarity, 6)) for r in df.collect())


@pytest.mark.parametrize("leaf_rows, fanout", [(8, 2), (16, 64)])
def test_top_k_and_range_equal_a_scan(spark, rows, tmp_path, leaf_rows, fanout):
    made = metric.build(rows, "namespace", leaf_rows=leaf_rows, fanout=fanout)
    made.save(str(tmp_path))
    index = metric.MetricIndex.open(spark, str(tmp_path))
    assert index.rows.count() == rows.count() == index.balls.filter("level = 1").agg(F.sum("size")).first()[0]
    queries = asked(rows)
    sound = queries.filter("vector is not null")
    found, cost = metric.indexed_top_k(index, queries, 5, "namespace")
    assert key(found) == key(search.top_k_each(rows, sound, 5, group="namespace"))
    near, range_cost = metric.indexed_range(index, queries, 0.9, "namespace")
    scan = search.top_k_each(rows, sound, None, group="namespace", least=0.9)
    assert key(near) == key(scan)
    spent = cost.filter("query_id < '00240'").agg(F.sum("compared"), F.sum("rows")).first()
    assert spent[0] <= spent[1] and spent[0] < 0.8 * spent[1]
    assert range_cost.agg(F.sum("compared")).first()[0] <= cost.agg(F.sum("rows")).first()[0]
    if fanout == 2:
        assert index.depth >= 4


def test_without_groups_and_empty(spark, rows):
    index = metric.build(rows, leaf_rows=8, fanout=4)
    queries = asked(rows).filter("vector is not null")
    assert key(metric.indexed_top_k(index, queries, 3)[0]) == key(search.top_k_each(rows, queries, 3))
    none = metric.build(rows.limit(0), "namespace")
    assert metric.indexed_top_k(none, queries, 3, "namespace")[0].count() == 0
    assert metric.indexed_top_k(index, queries.limit(0), 3)[0].count() == 0


def test_bound(spark):
    rng = np.random.default_rng(0)
    for _ in range(200):
        q, p, x = rng.normal(size=(3, 3))
        cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
        c, s = cos(q, p), cos(p, x)
        assert cos(q, x) <= (1 if c >= s else c * s + np.sqrt((1 - c * c) * (1 - s * s))) + 1e-9
    row = spark.range(1).select(metric.bound(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)), F.lit(0.8)).alias("b"), metric.bound(F.array(F.lit(1.0)), F.array(F.lit(0.0), F.lit(1.0)), F.lit(0.8)).alias("other")).first()
    assert abs(row.b - 0.6) < 1e-9 and row.other == 1.0


def test_no_row_for_a_query_and_a_leaf(spark, monkeypatch):
    """Where nothing can be skipped, a search wrote a row, with the query's vector, for each query and leaf."""
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(f"{k:04d}", rng.normal(size=32).tolist()) for k in range(600)], "node_id string, vector array<double>")
    queries = rows.filter("cast(node_id as int) % 10 = 0").select(F.col("node_id").alias("query_id"), "vector")
    index, most = metric.build(rows, leaf_rows=4, fanout=4), []

    def counted(df, real=metric.written):
        out = real(df)
        most.append(out.count() if "query" in out.columns else 0)
        return out

    monkeypatch.setattr(metric, "written", counted)
    found, cost = metric.indexed_top_k(index, queries, 3)
    assert key(found) == key(search.top_k_each(rows, queries, 3))
    seen = cost.agg(F.sum("compared").alias("n")).first().n
    leaves = index.balls.filter("level = 1").count()
    assert seen > 0.9 * 60 * 600 and max(most) < 60 * leaves / 4


def test_skipped_is_of_a_whole_search(spark, monkeypatch):
    """A query is a row of the index, so a search for one row ends at itself; the registered query tells what ten nearest cost (F10)."""
    from graphloom.plans import index_queries

    turn = np.random.default_rng(9).uniform(0, 2 * np.pi, 400)
    made = [(str(k), k, "g", [float(np.cos(x)), float(np.sin(x))]) for k, x in enumerate(turn)]
    df = spark.createDataFrame(made, "node_id string, doc_id long, namespace string, vector array<double>")
    monkeypatch.setattr(index_queries.tables, "nodes", lambda spark, d: df)
    got = {r.query_id: r.compared for r in index_queries.queries()["vec_index_skipped"](spark, "").collect()}
    index, queries = index_queries._index(spark, ""), index_queries._stated(df)
    compared = lambda k: {r.query_id: r.compared for r in metric.indexed_top_k(index, queries, k, "namespace")[1].collect()}
    assert got == compared(10) and len(got) == 20 and sum(compared(1).values()) < sum(got.values())
