"""Registered queries of structures that are kept and reused: vector indexes, growing hierarchies, summaries, caches, each beside its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import scratch, written
from graphloom.errors import Conflict
from graphloom.functions import text
from graphloom.operators import cluster, incremental, metric, summary
from graphloom.plans.queries import CLUSTERING, FIND, NODES, TREE, _stated
from graphloom.plans.registered import Registered
from graphloom.plans.store_queries import _node_rows, _store
from graphloom.sources import tables
from graphloom.streaming import cache

query = Registered()


def queries() -> dict:
    return dict(query.queries)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)


# --- vector index ----------------------------------------------------------------------------------------------------------------------


def _index(spark: SparkSession, d: str) -> metric.MetricIndex:
    return metric.build(tables.nodes(spark, d), "namespace", leaf_rows=64, fanout=8)


@query(f"""WITH {NODES}, r AS (SELECT q.doc_id AS query_id, n.node_id, round(list_cosine_similarity(q.v, n.v), 6) AS similarity FROM nodes q JOIN nodes n ON q.namespace = n.namespace WHERE q.doc_id % 20 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, node_id) AS rank FROM r) SELECT query_id, node_id, similarity, rank FROM k WHERE rank <= 10""")
def vec_topk_indexed(spark, d):
    found, _ = metric.indexed_top_k(_index(spark, d), _stated(tables.nodes(spark, d)), 10, "namespace")
    return found.select("query_id", "node_id", "similarity", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {NODES} SELECT q.doc_id AS query_id, n.node_id, round(list_cosine_similarity(q.v, n.v), 6) AS similarity FROM nodes q JOIN nodes n ON q.namespace = n.namespace WHERE q.doc_id % 20 = 0 AND round(list_cosine_similarity(q.v, n.v), 6) >= {FIND}")
def vec_range_indexed(spark, d):
    return metric.indexed_range(_index(spark, d), _stated(tables.nodes(spark, d)), FIND, "namespace")[0]


@query()
def vec_index_skipped(spark, d):
    """What the search of vec_topk_indexed compares for each query: rows of its namespace, rows compared, and the share that was skipped. A query is among the rows, so the nearest one alone would be itself."""
    _, cost = metric.indexed_top_k(_index(spark, d), _stated(tables.nodes(spark, d)), 10, "namespace")
    return cost.withColumn("skipped", F.round(1 - F.col("compared") / F.col("rows"), 6))


# --- growing hierarchies ---------------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {TREE} SELECT grp AS \"group\", cluster_id, depth, CAST(len(members) AS INTEGER) AS members, CAST(len(children) AS INTEGER) AS children, parent_id, round(internal_similarity, 6) AS internal_similarity, is_root, md5(left(text, {cluster.MOST_TEXT})) AS content_digest FROM tree")
def hierarchy_grown(spark, d):
    """The hierarchy of all nodes, grown by a second batch; the SQL builds it at once."""
    nodes, grown = tables.nodes(spark, d), None
    for batch in ("doc_id % 10 < 9", "doc_id % 10 = 9"):
        grown = incremental.grow(spark, nodes.filter(batch), grown, CLUSTERING)
    tree = grown.tree(spark)
    return tree.select("group", "cluster_id", "depth", F.size("members").alias("members"), F.size("children").alias("children"), "parent_id", F.round("internal_similarity", 6).alias("internal_similarity"), "is_root", F.md5("text").alias("content_digest"))


# --- keys of stored rows ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {NODES} SELECT namespace, count(*) AS nodes, true AS refused, count(*) FILTER (WHERE doc_id % 100 = 3) AS looked_up FROM nodes GROUP BY 1")
def store_unique_keys(spark, d):
    """Nodes added in two writes, then some of them again, which is refused; and some looked up by their ids."""
    store, rows = _store(spark), _node_rows(spark, d)
    store.append("nodes", rows.filter("doc_id % 2 = 0"))
    store.append("nodes", rows.filter("doc_id % 2 = 1"))
    refused = False
    try:
        store.append("nodes", rows.filter("doc_id % 50 = 7"))
    except Conflict:
        refused = True
    nodes = store.read("nodes")
    wanted = nodes.filter("cast(node_id as int) % 100 = 3").select("node_id").limit(5).collect()
    found = sum(store.get("nodes", r.node_id).count() for r in wanted)
    counts = nodes.groupBy("namespace").agg(F.count("*").alias("nodes"), F.count_if(F.col("node_id").cast("long") % 100 == 3).alias("looked_up"))
    return counts.withColumn("refused", F.lit(refused and found == len(wanted)))


# --- summaries -------------------------------------------------------------------------------------------------------------------------

_SHORT = lambda x: f"CASE WHEN length({x}) > 300 THEN left({x}, 300) || '...' ELSE {x} END"


@query(f"""WITH RECURSIVE {TREE}, own AS (SELECT node_id, {_SHORT(f"left(content, {cluster.MOST_TEXT})")} AS text FROM nodes),
lowest AS (SELECT grp, cluster_id, depth, parent_id, string_agg(own.text, chr(10) || chr(10) ORDER BY member) AS text FROM (SELECT grp, cluster_id, depth, parent_id, unnest(members) AS member FROM tree WHERE depth = 0) t JOIN own ON own.node_id = t.member GROUP BY ALL),
told AS (SELECT grp, cluster_id, depth, parent_id, {_SHORT("text")} AS summary FROM lowest
  UNION ALL SELECT grp, cluster_id, depth, parent_id, {_SHORT("text")} FROM (SELECT tree.grp, tree.cluster_id, tree.depth, tree.parent_id, string_agg(summary, chr(10) || chr(10) ORDER BY told.cluster_id) AS text FROM told JOIN tree ON tree.cluster_id = told.parent_id GROUP BY 1, 2, 3, 4))
SELECT grp AS "group", cluster_id, depth, md5(summary) AS digest FROM told""")
def tree_summaries(spark, d):
    nodes = tables.nodes(spark, d)
    found = summary.tree_summaries(cluster.hierarchy(nodes, CLUSTERING, content=None), nodes, lambda c: text.shorten(c, 300))
    return found.select("group", "cluster_id", "depth", F.md5("summary").alias("digest"))


@query()
def tree_summaries_central(spark, d):
    """Summaries by the extractive scorer, which SQL can't say, of whole texts."""
    nodes = tables.nodes(spark, d)
    return summary.tree_summaries(cluster.hierarchy(nodes, CLUSTERING, content=None), nodes, most_text=None)


# --- embeddings that are kept ----------------------------------------------------------------------------------------------------------

#: The runs over documents: hours since the first, and the ids of each by their remainders by three.
RUNS = ((0, (0,)), (1, (0, 1)), (24.5, (0, 1, 2)))


def _lengths(texts: list[str]) -> list[list[float]]:
    """An embedder for the test tables: bytes and characters of a text."""
    return [[float(len(x.encode())), float(len(x))] for x in texts]


@query("""WITH t AS (SELECT text, bool_or(doc_id % 3 = 0) AS first, bool_or(doc_id % 3 = 1) AS second FROM documents WHERE trim(text) <> '' GROUP BY 1), n AS (SELECT doc_id % 3 AS part, count(*) AS n, sum(strlen(text)) AS bytes FROM documents WHERE trim(text) <> '' GROUP BY 1)
SELECT CAST(0 AS INTEGER) AS run, count(*) FILTER (WHERE first) AS embedded, (SELECT CAST(sum(n) AS BIGINT) FROM n WHERE part = 0) AS texts, (SELECT CAST(sum(bytes) AS BIGINT) FROM n WHERE part = 0) AS bytes FROM t
UNION ALL SELECT 1, count(*) FILTER (WHERE second AND NOT first), (SELECT CAST(sum(n) AS BIGINT) FROM n WHERE part < 2), (SELECT CAST(sum(bytes) AS BIGINT) FROM n WHERE part < 2) FROM t
UNION ALL SELECT 2, count(*) FILTER (WHERE first OR NOT second), (SELECT CAST(sum(n) AS BIGINT) FROM n), (SELECT CAST(sum(bytes) AS BIGINT) FROM n) FROM t""")
def embedding_cache(spark, d):
    """Three runs: the second embeds only new texts; at the third those of the first have expired."""
    store, docs, out = cache.EmbeddingCache(spark, scratch(spark), "lengths", _lengths), tables.table(spark, d, "documents"), None
    for run, (hours, parts) in enumerate(RUNS):
        now = F.timestamp_seconds(F.lit(1704067200 + int(hours * 3600)))
        vectors, made = store.vectors(docs.filter((F.col("doc_id") % 3).isin(*parts)), now, "doc_id")
        row = vectors.agg(F.count("*").alias("texts"), F.sum(F.col("vector")[0]).cast("long").alias("bytes")).select(F.lit(run).alias("run"), F.lit(made).cast("long").alias("embedded"), "texts", "bytes")
        out = written(row) if out is None else out.unionByName(written(row))
    return out
