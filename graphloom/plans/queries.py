"""The registered queries of the knowledge engine, each beside the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import scratch, written
from graphloom.functions import rules, text, vectors
from graphloom.operators import cluster, nearness, paths, search
from graphloom.operators.chunk import chunked
from graphloom.operators import chunk
from graphloom.plans import api, oracles
from graphloom.plans.registered import Registered
from graphloom.sources import tables
from graphloom.sources.tables import table
from graphloom.streaming import cache, uploads

query = Registered()

#: Thresholds for the test vectors, which are nearly orthogonal: links, hierarchies and searches.
LINK, FIND = 0.3, 0.2
CLUSTERING = cluster.ClusterConfig(threshold=LINK)

NODES = """nodes AS (SELECT CAST(d.doc_id AS VARCHAR) AS node_id, d.doc_id, d.text AS content, d.source, d.lang, CAST(e.embedding AS DOUBLE[]) AS v,
  CASE WHEN d.lang = 'en' THEN 'global_knowledge' ELSE 'user_' || d.lang END AS namespace,
  CASE WHEN l.toxic = 1 THEN 'deprecated' WHEN l.quality = 0 THEN 'incomplete' WHEN l.quality IS NULL THEN 'pending' ELSE 'complete' END AS status
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
EDGES = f"""{NODES}, pairs AS (SELECT a.node_id AS src, b.node_id AS dst, a.namespace, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
  FROM nodes a JOIN nodes b ON a.namespace = b.namespace AND a.node_id < b.node_id), edges AS (SELECT * FROM pairs WHERE similarity >= {LINK})"""
MODEL_NODES = """model_nodes AS (SELECT 'r' || r_regionkey AS id, 'fractal_models:' || r_regionkey AS model_id, NULL AS parent_id, 2 AS level, NULL AS v FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'fractal_models:' || n_regionkey, 'r' || n_regionkey, 1, NULL FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'fractal_models:' || n_regionkey, 'n' || n_nationkey, 0, CAST(embedding AS DOUBLE[]) FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN embeddings ON vec_id = s_suppkey)"""
ACCESS = "access AS (SELECT user_id AS doc_id, count(*) AS access_count, max(ts) AS last_accessed_at FROM events GROUP BY 1)"
SESSIONS = """sessions AS (SELECT o_orderkey AS upload_id, 7 AS total_chunks, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'uploading' ELSE 'converting' END AS status, o_orderdate AS created_at FROM orders),
  got AS (SELECT l_orderkey AS upload_id, count(DISTINCT l_linenumber) AS n, list_sort(list_distinct(list(l_linenumber - 1))) AS chunks FROM lineitem GROUP BY 1)"""


TREE = f"{NODES},\n{oracles.tree(LINK)}"
BOTH = f"{EDGES}, both_ways AS (SELECT src, dst, similarity FROM edges UNION ALL SELECT dst, src, similarity FROM edges), lengths AS (SELECT src, dst, 1 / similarity AS length FROM both_ways), starts AS (SELECT node_id AS q, node_id AS node FROM nodes WHERE doc_id % 20 = 0)"
#: Rounds after which no distance in the test graphs changes: more than any shortest path has edges.
ROUNDS = 40
REACHED = f"{BOTH}, {oracles.shortest('lengths', 'starts', 'found', ROUNDS)}"


def queries() -> dict:
    return dict(query.queries)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first().embedding


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.similarity_edges(tables.nodes(spark, sf_dir), LINK)


def _stated(nodes: DataFrame) -> DataFrame:
    """The stated query set: nodes whose id divides by 20."""
    return nodes.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector", "namespace")


# --- vector search ---------------------------------------------------------------------------------------------------------------------


@query(f"WITH {NODES}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) SELECT node_id, namespace, round(list_cosine_similarity(v, q), 6) AS similarity FROM nodes, q WHERE namespace = 'global_knowledge' ORDER BY similarity DESC, node_id LIMIT 10")
def vec_topk(spark, d):
    rows = tables.nodes(spark, d).filter(F.col("namespace") == rules.GLOBAL)
    return search.top_k(rows, _vector(spark, d), 10).select("node_id", "namespace", "similarity")


@query(f"WITH {NODES}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) SELECT node_id, round(list_cosine_similarity(v, q), 6) AS similarity FROM nodes, q WHERE round(list_cosine_similarity(v, q), 6) >= {FIND} ORDER BY similarity DESC, node_id LIMIT 20")
def vec_topk_threshold(spark, d):
    return search.top_k(tables.nodes(spark, d), _vector(spark, d), 20, least=FIND).select("node_id", "similarity")


@query(f"""WITH {NODES}, r AS (SELECT q.doc_id AS query_id, n.node_id, round(list_cosine_similarity(q.v, n.v), 6) AS similarity FROM nodes q JOIN nodes n ON q.namespace = n.namespace WHERE q.doc_id % 20 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, node_id) AS rank FROM r) SELECT query_id, node_id, similarity, rank FROM k WHERE rank <= 10""")
def vec_topk_per_query(spark, d):
    nodes = tables.nodes(spark, d)
    return search.top_k_each(nodes, _stated(nodes), 10, group="namespace").select("query_id", "node_id", "similarity", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {MODEL_NODES}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) SELECT id, round(list_cosine_similarity(v, q), 6) AS similarity FROM model_nodes, q WHERE model_id = 'fractal_models:1' AND v IS NOT NULL ORDER BY similarity DESC, id LIMIT 5")
def model_node_topk(spark, d):
    rows = tables.model_nodes(spark, d).filter("model_id = 'fractal_models:1' and vector is not null")
    return search.top_k(rows, _vector(spark, d), 5, "id").select("id", "similarity")


@query(f"WITH {NODES}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 1) SELECT node_id, round(list_cosine_similarity(v, q), 6) AS similarity FROM nodes, q WHERE doc_id <> 1 ORDER BY similarity DESC, node_id LIMIT 1")
def most_similar_one(spark, d):
    return search.top_k(tables.nodes(spark, d).filter("doc_id != 1"), _vector(spark, d, 1), 1).select("node_id", "similarity")


@query(f"WITH {NODES}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) SELECT node_id, round(list_distance(v, q), 6) AS distance FROM nodes, q ORDER BY distance, node_id LIMIT 10")
def euclid_topk(spark, d):
    return search.nearest(tables.nodes(spark, d), _vector(spark, d), 10).select("node_id", "distance")


@query(f"WITH {EDGES} SELECT src, dst, namespace, similarity, round(1 / similarity, 6) AS weight FROM edges")
def pairwise_sim_edges(spark, d):
    return _edges(spark, d).select("src", "dst", "namespace", "similarity", "weight")


@query(f"WITH {NODES}, p AS (SELECT a.namespace, list_cosine_similarity(a.v, b.v) AS s FROM nodes a JOIN nodes b ON a.namespace = b.namespace AND a.node_id < b.node_id) SELECT n.namespace, n.members, round(coalesce(p.s, 1.0), 6) AS average_similarity FROM (SELECT namespace, count(*) AS members FROM nodes GROUP BY 1) n LEFT JOIN (SELECT namespace, avg(s) AS s FROM p GROUP BY 1) p USING (namespace)")
def avg_pairwise_by_ns(spark, d):
    return search.average_pairwise(tables.nodes(spark, d), "namespace").withColumn("average_similarity", F.round("average_similarity", 6))


CENTROIDS = f"{NODES}, parts AS (SELECT namespace, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM nodes), c AS (SELECT namespace, place, avg(x) AS x FROM parts GROUP BY 1, 2)"


@query(f"WITH {CENTROIDS} SELECT namespace, CAST(place - 1 AS INTEGER) AS place, round(x, 6) AS x FROM c")
def centroid_by_ns(spark, d):
    return search.centroids(tables.nodes(spark, d), "namespace").select("namespace", F.posexplode("centroid").alias("place", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {CENTROIDS}, m AS (SELECT namespace, list(x ORDER BY place) AS m FROM c GROUP BY 1) SELECT node_id, round(list_cosine_similarity(v, m), 6) AS similarity FROM nodes JOIN m USING (namespace)")
def sim_to_centroid(spark, d):
    nodes = tables.nodes(spark, d)
    return nodes.join(search.centroids(nodes, "namespace"), "namespace").select("node_id", F.round(vectors.cosine(F.col("vector"), F.col("centroid")), 6).alias("similarity"))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm, abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) < 1e-6 AS unit FROM embeddings")
def normalize_check(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(v), 5).alias("norm"), vectors.is_normalized(v).alias("unit"))


@query("SELECT o_orderkey, CASE WHEN s <= 0 THEN 3.4028234663852886e38 ELSE 1 / s END AS distance, CASE WHEN s <= 0 THEN 0.0 ELSE round(s, 6) END AS back FROM (SELECT o_orderkey, (o_orderkey % 7 - 1) / 5.0::DOUBLE AS s FROM orders)")
def sim_dist_roundtrip(spark, d):
    s = (F.col("o_orderkey") % 7 - 1) / 5.0
    distance = vectors.to_distance(s)
    return table(spark, d, "orders").select("o_orderkey", distance.alias("distance"), F.round(vectors.to_similarity(distance), 6).alias("back"))


# --- repository ------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {NODES} SELECT node_id, status FROM nodes WHERE namespace = 'user_fr'")
def nodes_by_namespace(spark, d):
    return tables.nodes(spark, d).filter("namespace = 'user_fr'").select("node_id", "status")


@query(f"WITH {NODES} SELECT node_id, namespace FROM nodes WHERE status = 'incomplete'")
def nodes_by_status(spark, d):
    return tables.nodes(spark, d).filter("status = 'incomplete'").select("node_id", "namespace")


@query(f"WITH {NODES} SELECT node_id, namespace FROM nodes WHERE namespace = 'global_knowledge'")
def leaf_nodes(spark, d):
    return tables.nodes(spark, d).filter("namespace = 'global_knowledge' and node_type = 'leaf' and depth_level = 0").select("node_id", "namespace")


@query(f"WITH {NODES}, {ACCESS} SELECT node_id, access_count FROM nodes JOIN access USING (doc_id) WHERE access_count > 10 ORDER BY access_count DESC, node_id LIMIT 20")
def hot_nodes(spark, d):
    used = tables.nodes(spark, d).join(tables.access(spark, d), "doc_id").filter(rules.is_hot(F.col("access_count")))
    return used.orderBy(F.desc("access_count"), "node_id").limit(20).select("node_id", "access_count")


@query(f"WITH {EDGES} SELECT src, count(*) AS outgoing FROM edges GROUP BY 1")
def edges_out(spark, d):
    return _edges(spark, d).groupBy("src").agg(F.count("*").alias("outgoing"))


@query(f"WITH {EDGES} SELECT dst, count(*) AS incoming FROM edges GROUP BY 1")
def edges_in(spark, d):
    return _edges(spark, d).groupBy("dst").agg(F.count("*").alias("incoming"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN s <= 0 THEN 3.4028234663852886e38 ELSE 1 / s END AS weight, s BETWEEN 0 AND 1 AND c BETWEEN 0 AND 1 AS valid FROM (SELECT l_orderkey, l_linenumber, l_discount * 12 - 0.1 AS s, l_tax * 13 AS c FROM lineitem)")
def edge_validity(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 12 - 0.1).alias("s"), (F.col("l_tax") * 13).alias("c"))
    weight = rules.edge_weight(F.col("s"))
    return rows.select("l_orderkey", "l_linenumber", weight.alias("weight"), rules.edge_valid(weight, F.col("s"), F.col("c")).alias("valid"))


@query(f"WITH {NODES} SELECT node_id, round(list_cosine_similarity(v, v) * 0.85, 6) AS relevance FROM nodes")
def relevance(spark, d):
    v = F.col("vector")
    return tables.nodes(spark, d).select("node_id", F.round(vectors.cosine(v, v) * 0.85, 6).alias("relevance"))


@query(f"WITH {EDGES}, n AS (SELECT namespace, count(*) AS node_count FROM nodes GROUP BY 1), e AS (SELECT namespace, count(*) AS edge_count FROM edges GROUP BY 1) SELECT namespace, node_count, coalesce(edge_count, 0) AS edge_count FROM n LEFT JOIN e USING (namespace)")
def namespace_stats(spark, d):
    return api.namespace_stats(tables.nodes(spark, d), _edges(spark, d))


@query(f"WITH {MODEL_NODES} SELECT model_id, level, count(*) AS nodes FROM model_nodes GROUP BY 1, 2")
def count_by_level(spark, d):
    return tables.model_nodes(spark, d).groupBy("model_id", "level").agg(F.count("*").alias("nodes"))


@query("SELECT 'fractal_models:' || r_regionkey AS id, r_name AS name, TIMESTAMP '2024-01-01' + to_days(CAST(r_regionkey * 7 % 5 AS INTEGER)) AS created_at FROM region WHERE r_regionkey % 3 = 0 ORDER BY created_at DESC")
def models_by_status_newest(spark, d):
    return tables.models(spark, d).filter("status = 'ready'").orderBy(F.desc("created_at"), "id").select("id", "name", "created_at")


@query(f"WITH {MODEL_NODES} SELECT r.model_id, r.id AS root_id, c.id AS child_id FROM model_nodes r JOIN model_nodes c ON c.parent_id = r.id WHERE r.parent_id IS NULL")
def root_and_children(spark, d):
    nodes = tables.model_nodes(spark, d)
    roots = nodes.filter("parent_id is null").select("model_id", F.col("id").alias("root_id"))
    return roots.join(nodes.select(F.col("id").alias("child_id"), F.col("parent_id").alias("root_id")), "root_id").select("model_id", "root_id", "child_id")


@query("SELECT 'fractal_models:' || r_regionkey AS id, CAST(r_regionkey AS VARCHAR) AS short_id, r_regionkey % 3 = 1 OR r_regionkey % 3 = 0 AS refused FROM region")
def convert_guard(spark, d):
    return tables.models(spark, d).select("id", rules.thing_id(F.col("id")).alias("short_id"), F.col("status").isin("converting", "ready").alias("refused"))


@query("SELECT r_regionkey, CASE WHEN p >= 1000000000 THEN printf('%.1fB', p / 1e9) WHEN p >= 1000000 THEN printf('%.1fM', p / 1e6) WHEN p >= 1000 THEN printf('%.1fK', p / 1e3) ELSE CAST(p AS VARCHAR) END AS parameters FROM (SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 500 WHEN 1 THEN 1500 WHEN 2 THEN 7000000 ELSE CAST(r_regionkey AS BIGINT) * 1500000007 END AS p FROM region)")
def format_params(spark, d):
    k = F.col("r_regionkey").cast("long")
    p = F.when(k == 0, 500).when(k == 1, 1500).when(k == 2, 7000000).otherwise(k * 1500000007)
    return table(spark, d, "region").select("r_regionkey", rules.format_params(p).alias("parameters"))


# --- uploads, progress, caches ---------------------------------------------------------------------------------------------------------


@query(f"WITH {SESSIONS} SELECT upload_id, coalesce(n, 0) AS n_received, CAST(7 - coalesce(n, 0) AS BIGINT) AS n_missing, coalesce((SELECT min(x) FROM range(0, 7) t(x) WHERE NOT list_contains(chunks, x)), CASE WHEN n IS NULL THEN 0 ELSE -1 END) AS first_missing FROM sessions LEFT JOIN got USING (upload_id)")
def missing_chunks(spark, d):
    rows = uploads.received(tables.sessions(spark, d), tables.chunk_arrivals(spark, d))
    return rows.select("upload_id", "n_received", F.size("missing").cast("long").alias("n_missing"), F.coalesce(F.try_element_at("missing", F.lit(1)), F.lit(-1)).alias("first_missing"))


@query(f"WITH {SESSIONS} SELECT upload_id, status, round(coalesce(n, 0) / 7.0::DOUBLE * 100, 6) AS upload_progress FROM sessions LEFT JOIN got USING (upload_id) WHERE status IN ('uploading', 'finalizing', 'converting')")
def upload_progress(spark, d):
    rows = uploads.active(uploads.received(tables.sessions(spark, d), tables.chunk_arrivals(spark, d)))
    return rows.select("upload_id", "status", "upload_progress")


@query(f"WITH {SESSIONS} SELECT upload_id, 'cancelled' AS status FROM sessions WHERE status = 'uploading' AND created_at < (SELECT max(created_at) FROM sessions) - INTERVAL 24 HOURS")
def expired_sessions(spark, d):
    rows = tables.sessions(spark, d)
    now = rows.agg(F.max("created_at")).first()[0]  # one row
    return uploads.expired(rows, F.lit(now)).select("upload_id", "status")


@query("SELECT upload_id, CASE WHEN n = 7 AND status = 'uploading' THEN 'finalizing' ELSE status END AS status FROM (SELECT o_orderkey AS upload_id, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'uploading' ELSE 'converting' END AS status FROM orders) s LEFT JOIN (SELECT l_orderkey AS upload_id, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE l_linenumber <= 7 GROUP BY 1) g USING (upload_id)")
def finalize_uploads(spark, d):
    rows = uploads.received(tables.sessions(spark, d), tables.chunk_arrivals(spark, d))
    done = uploads.may_finalize(rows).select("upload_id", F.col("status").alias("new"))
    return rows.join(done, "upload_id", "left").select("upload_id", F.coalesce("new", "status").alias("status"))


@query("SELECT l_orderkey AS upload_id, count(*) AS arrivals, sum(CAST(sha256(CAST(l_linenumber AS VARCHAR)) = sha256(CAST(l_linenumber % 5 AS VARCHAR)) AS BIGINT))::BIGINT AS valid FROM lineitem GROUP BY 1")
def chunk_checksums(spark, d):
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("upload_id"), n.cast("string").cast("binary").alias("data"), F.sha2((n % 5).cast("string").cast("binary"), 256).alias("checksum"))
    return uploads.verified(rows).groupBy("upload_id").agg(F.count("*").alias("arrivals"), F.sum(F.col("valid").cast("long")).alias("valid"))


@query("SELECT CAST(l_orderkey // 256 AS VARCHAR) AS upload_id, strlen(string_agg(c, '' ORDER BY k)) AS size, sha256(string_agg(c, '' ORDER BY k)) AS sha256 FROM (SELECT DISTINCT l_orderkey, 16 * l_orderkey + l_linenumber AS k, 'chunk-' || l_linenumber || ' of ' || l_orderkey || chr(10) AS c FROM lineitem) GROUP BY 1")
def reassemble_uploads(spark, d):
    """Chunks of the uploads written as files, in their places, and the files' digests."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    text = F.concat(F.lit("chunk-"), line.cast("string"), F.lit(" of "), order.cast("string"), F.lit("\n"))
    folder = scratch(spark)
    uploads.assemble(table(spark, d, "lineitem").select(F.floor(order / 256).cast("string").alias("upload_id"), (16 * order + line).alias("chunk"), text.cast("binary").alias("data")), folder)
    return uploads.digests(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("upload_id"), "size", "sha256")


@query("SELECT l_orderkey, l_linenumber, CASE stage WHEN 0 THEN 10.0 WHEN 1 THEN 20.0 WHEN 2 THEN 20 + 0.5 * p WHEN 3 THEN 70 + 0.25 * p WHEN 4 THEN 100.0 ELSE 0.0 END AS progress FROM (SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS stage, round(l_quantity / 50 * 100, 6) AS p FROM lineitem)")
def overall_progress(spark, d):
    names = F.array(*(F.lit(x) for x in ("extracting", "chunking", "embedding", "persisting", "complete", "failed", "unknown")))
    stage = F.get(names, F.col("l_linenumber") - 1)
    done = F.round(F.col("l_quantity") / 50 * 100, 6) / 100
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.overall_progress(stage, done, done, F.lit(1)).alias("progress"))


@query("SELECT event_id, hour(ts) >= 22 OR hour(ts) < 6 AS night, hour(ts) >= 9 AND hour(ts) < 17 AS office, true AS always FROM events")
def is_rem_time(spark, d):
    hour = F.hour("ts")
    return table(spark, d, "events").select("event_id", rules.is_rem_time(hour, 22, 6).alias("night"), rules.is_rem_time(hour, 9, 17).alias("office"), rules.is_rem_time(hour, 3, 3).alias("always"))


def _cache_ops(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_id") % 3 == 0, "put").otherwise("get")
    key = (F.col("user_id") % 40).cast("string")
    return table(spark, d, "events").select(F.col("event_type").alias("cache"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), op.alias("op"), key.alias("key"), F.lit("v").alias("value"), F.lit(None).cast("double").alias("ttl_seconds"))


@query("WITH RECURSIVE ops AS (SELECT event_type AS cache, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, CASE WHEN event_id % 3 = 0 THEN 'put' ELSE 'get' END AS op, CAST(user_id % 40 AS VARCHAR) AS key, epoch_us(ts) / 1e6 AS seen FROM events),\n" + oracles.lru("ops", 20, 6 * 3600.0))
def lru_metrics(spark, d):
    return cache.replay(_cache_ops(spark, d), capacity=20, ttl=6 * 3600.0)


@query("SELECT event_type AS cache, count(DISTINCT user_id % 40) AS keys, count(*) FILTER (WHERE event_id % 3 = 0) AS puts, count(*) FILTER (WHERE event_id % 3 <> 0) AS gets FROM events GROUP BY 1")
def cache_traffic(spark, d):
    ops = _cache_ops(spark, d)
    return ops.groupBy("cache").agg(F.countDistinct("key").alias("keys"), F.count_if(F.col("op") == "put").alias("puts"), F.count_if(F.col("op") == "get").alias("gets"))


@query(f"WITH {NODES} SELECT DISTINCT CAST(d.doc_id AS VARCHAR) AS node_id FROM documents d LEFT JOIN nodes n ON n.doc_id = d.doc_id WHERE n.doc_id IS NULL")
def cache_unseen(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("node_id"))
    return cache.unseen(docs, tables.nodes(spark, d), "node_id")


# --- text ------------------------------------------------------------------------------------------------------------------------------


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '[^\S\n]+', ' ', 'g'), '\n\s*', chr(10), 'g'), '^\s+', '', 'g'), '\s+$', '', 'g')) AS digest FROM pages")
def squeeze_whitespace(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.squeeze(F.col("html"))).alias("digest"))


@query("SELECT doc_id, md5(replace(replace(replace(text, ' ', chr(13) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM documents")
def line_endings(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.unix_lines(F.replace("text", F.lit(" "), F.lit("\r\n")))).alias("digest"))


@query("SELECT page_id, CASE k WHEN 0 THEN 'text' WHEN 1 THEN 'pdf' WHEN 2 THEN 'image' ELSE 'unknown' END AS file_type, CASE k WHEN 0 THEN 'text' WHEN 1 THEN 'pdf' WHEN 2 THEN 'image' ELSE 'unknown' END AS by_mime FROM (SELECT page_id, page_id % 4 AS k FROM pages)")
def file_type_detect(spark, d):
    k = F.col("page_id") % 4
    name = F.concat(F.lit("a.b/file"), F.col("page_id").cast("string"), F.when(k == 0, ".MD").when(k == 1, ".pdf").when(k == 2, ".JpEg").otherwise(".zip"))
    mime = F.when(k == 0, "text/markdown").when(k == 1, "application/pdf").when(k == 2, "image/png").otherwise("application/zip")
    return table(spark, d, "pages").select("page_id", text.file_type(name).alias("file_type"), text.mime_type(mime).alias("by_mime"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS domain FROM pages")
def domain_extract(spark, d):
    return table(spark, d, "pages").select("page_id", text.domain(F.col("url")).alias("domain"))


@query(r"SELECT doc_id, array_to_string(list_slice(list_filter(regexp_split_to_array(substring(text, 1, 100), '\s+'), lambda x: x <> ''), 1, 10), ' ') AS query FROM documents")
def search_query_build(spark, d):
    return table(spark, d, "documents").select("doc_id", text.search_query(F.col("text")).alias("query"))


RESULTS = "results AS (SELECT page_id, page_id // 10 AS query_id, CAST(page_id % 10 AS INTEGER) AS position, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, round(0.95 - 0.05 * (page_id % 10), 6) AS score FROM pages)"


@query(f"WITH {RESULTS} SELECT query_id, md5(string_agg('• ' || title || ' (' || url || ')' || chr(10) || 'page ' || page_id, chr(10) || chr(10) ORDER BY position)) AS digest FROM results GROUP BY 1")
def combined_snippets(spark, d):
    line = text.snippet_line(F.col("title"), F.col("url"), F.concat(F.lit("page "), F.col("page_id").cast("string")))
    return tables.search_results(spark, d).groupBy("query_id").agg(F.md5(text.ordered_text(F.col("position"), line, text.PART_BREAK)).alias("digest"))


@query(f"WITH {RESULTS} SELECT page_id, score FROM results WHERE score >= 0.7")
def results_above_score(spark, d):
    return tables.search_results(spark, d).filter("score >= 0.7").select("page_id", "score")


@query("SELECT item_id AS query_id, p AS position, round(0.9 - 0.1 * p, 6) AS score, s || ' - ' || q AS title FROM (SELECT item_id, replace(text, chr(10), ' ') AS q FROM benchmark), (SELECT unnest(['Wikipedia', 'Stack Overflow', 'GitHub', 'Documentation', 'Blog Post']) AS s, unnest([0, 1, 2, 3, 4]) AS p) WHERE trim(q) <> ''")
def mock_search(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("query"))
    return api.mock_search(asked).select("query_id", "position", "score", "title")


@query("SELECT user_id, sum(event_id)::BIGINT AS n, 'chunk:' || min(event_id) || '/' || max(event_id) AS tag FROM events GROUP BY 1")
def tag_format(spark, d):
    tag = F.concat(F.lit("chunk:"), F.min("event_id").cast("string"), F.lit("/"), F.max("event_id").cast("string"))
    return table(spark, d, "events").groupBy("user_id").agg(F.sum("event_id").alias("n"), tag.alias("tag"))


@query("SELECT doc_id, CAST(list_reduce(list_prepend(5381::HUGEINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(('0x' || x) AS HUGEINT))), lambda h, b: (h * 33 + b) % 18446744073709551616::HUGEINT) AS VARCHAR) AS hash FROM documents")
def text_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", vectors.text_hash(F.col("text")).cast("string").alias("hash"))


@query("SELECT doc_id, CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(('0x' || x) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS VARCHAR) AS hash FROM documents")
def fnv_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", vectors.fnv1a(F.col("text")).cast("string").alias("hash"))


@query("""WITH h AS (SELECT doc_id, list_reduce(list_prepend(5381::HUGEINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(('0x' || x) AS HUGEINT))), lambda h, b: (h * 33 + b) % 18446744073709551616::HUGEINT) AS h FROM documents),
  raw AS (SELECT doc_id, i, CAST((((h + i) % 18446744073709551616::HUGEINT) * 2654435761 % 18446744073709551616::HUGEINT) % 10000 AS DOUBLE) / 10000 - 0.5 AS x FROM h, range(0, 16) t(i))
  SELECT doc_id, CAST(i AS INTEGER) AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS x FROM raw""")
def mock_embed(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(vectors.mock_embedding(F.col("text"), 16)).alias("place", "x"))
    return rows.withColumn("x", F.round("x", 6))


@query(oracles.chunks(1000, 200, 100, chunk.LOOK_BACK, chunk.LOOK_AHEAD, chunk.BREAKS))
def chunk_documents(spark, d):
    return chunked(table(spark, d, "documents"))


@query("SELECT lang, count(*) AS n, CAST(sum(strlen(text)) // count(*) AS BIGINT) AS average_size FROM documents WHERE trim(text) <> '' GROUP BY 1")
def average_sizes(spark, d):
    full = table(spark, d, "documents").filter(F.trim("text") != "")
    return full.groupBy("lang").agg(F.count("*").alias("n"), F.floor(F.sum(F.octet_length("text").cast("long")) / F.count("*")).alias("average_size"))


@query(f"""WITH RECURSIVE chunks AS ({oracles.chunks(1000, 200, 100, chunk.LOOK_BACK, chunk.LOOK_AHEAD, chunk.BREAKS)})
SELECT lang, count(*) AS chunks, count(DISTINCT doc_id) AS documents, CAST(sum(strlen(content)) // count(*) AS BIGINT) AS average_size, CAST(max(strlen(content)) AS BIGINT) AS largest FROM chunks JOIN documents USING (doc_id) GROUP BY 1""")
def average_chunk_sizes(spark, d):
    docs = table(spark, d, "documents")
    size = F.octet_length("content").cast("long")
    parts = chunked(docs).join(docs.select("doc_id", "lang"), "doc_id")
    return parts.groupBy("lang").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.floor(F.sum(size) / F.count("*")).alias("average_size"), F.max(size).alias("largest"))


# --- clusters and paths ----------------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {NODES}, rows AS (SELECT namespace AS grp, node_id AS id, v FROM nodes), {oracles.clusters('rows', 'c', LINK, 10, 2)} SELECT grp AS \"group\", id, first AS cluster FROM c_kept")
def cluster_flat(spark, d):
    return cluster.clusters(tables.nodes(spark, d), CLUSTERING)


@query(f"""WITH RECURSIVE {NODES}, rows AS (SELECT namespace AS grp, node_id AS id, v FROM nodes), {oracles.clusters('rows', 'c', LINK, 10, 2)}, n AS (SELECT grp, count(*) AS nodes FROM rows GROUP BY 1)
SELECT grp AS "group", any_value(nodes) AS nodes, count(DISTINCT first) AS clusters, round(count(*) / count(DISTINCT first), 6) AS average_size, any_value(nodes) - count(*) AS orphans FROM n JOIN c_kept USING (grp) GROUP BY grp""")
def cluster_summary(spark, d):
    nodes = tables.nodes(spark, d)
    found = cluster.clusters(nodes, CLUSTERING)
    sizes = found.groupBy("group").agg(F.countDistinct("cluster").alias("clusters"), F.count("*").alias("placed"))
    total = nodes.groupBy(F.col("namespace").alias("group")).agg(F.count("*").alias("nodes"))
    return total.join(sizes, "group", "left").select("group", "nodes", "clusters", F.round(F.col("placed") / F.col("clusters"), 6).alias("average_size"), (F.col("nodes") - F.col("placed")).alias("orphans"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """The hierarchy for queries that don't read its texts."""
    return cluster.hierarchy(tables.nodes(spark, d), CLUSTERING, content=None)


@query(f"WITH RECURSIVE {TREE} SELECT grp AS \"group\", cluster_id, depth, CAST(len(members) AS INTEGER) AS members, CAST(len(children) AS INTEGER) AS children, parent_id, round(internal_similarity, 6) AS internal_similarity, is_root, md5(text) AS content_digest FROM tree")
def hierarchy_levels(spark, d):
    tree = cluster.hierarchy(tables.nodes(spark, d), CLUSTERING, most_text=None)
    return tree.select("group", "cluster_id", "depth", F.size("members").alias("members"), F.size("children").alias("children"), "parent_id", F.round("internal_similarity", 6).alias("internal_similarity"), "is_root", F.md5("text").alias("content_digest"))


@query(f"WITH RECURSIVE {TREE} SELECT grp AS \"group\", depth, count(*) AS clusters, round(avg(len(members) + len(children)), 6) AS average_size, round(avg(internal_similarity), 6) AS average_internal_similarity FROM tree GROUP BY 1, 2")
def hierarchy_stats(spark, d):
    return cluster.tree_stats(_tree(spark, d))


@query(f"WITH RECURSIVE {TREE}, {oracles.SIBLINGS.format(least=0.1)} SELECT * FROM siblings")
def sibling_edges(spark, d):
    return cluster.sibling_edges(_tree(spark, d), 0.1)


@query(f"""WITH RECURSIVE {TREE}, up AS (SELECT cluster_id, cluster_id AS path, parent_id FROM tree UNION ALL SELECT u.cluster_id, u.path || '>' || t.cluster_id, t.parent_id FROM up u JOIN tree t ON t.cluster_id = u.parent_id)
SELECT cluster_id, path FROM up WHERE parent_id IS NULL""")
def path_to_root(spark, d):
    return cluster.path_to_root(_tree(spark, d)).select("cluster_id", F.array_join("path", ">").alias("path"))


@query(f"""WITH RECURSIVE {TREE}, scored AS (SELECT *, round(list_cosine_similarity(v, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM tree),
walk AS (SELECT cluster_id FROM scored WHERE is_root AND similarity >= 0.05 UNION SELECT s.cluster_id FROM walk w JOIN scored s ON s.parent_id = w.cluster_id WHERE s.similarity >= 0.05)
SELECT grp AS "group", cluster_id, depth, similarity FROM scored JOIN walk USING (cluster_id)""")
def traverse_from_roots(spark, d):
    return cluster.traverse(_tree(spark, d), _vector(spark, d), 0.05)


@query(f"""WITH RECURSIVE {MODEL_NODES}, walk AS (SELECT id, id AS top, parent_id, 0 AS steps FROM model_nodes UNION ALL SELECT w.id, m.id, m.parent_id, w.steps + 1 FROM walk w JOIN model_nodes m ON m.id = w.parent_id)
  SELECT id AS cluster_id, top AS root_id, steps FROM walk WHERE parent_id IS NULL""")
def model_path_to_root(spark, d):
    walked = cluster.path_to_root(tables.model_nodes(spark, d).select(F.col("id").alias("cluster_id"), "parent_id"))
    return walked.select("cluster_id", F.element_at("path", -1).alias("root_id"), (F.size("path") - 1).alias("steps"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return tables.nodes(spark, d).filter("doc_id % 20 = 0").select(F.col("node_id").alias("source"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Each node with its namespace and vector: no edge leads from one namespace to another."""
    return tables.nodes(spark, d).select(F.col("node_id").alias("node"), F.col("namespace").alias("space"), "vector")


def _told(found: DataFrame) -> DataFrame:
    return found.withColumns({"distance": F.round("distance", 6), "path": F.array_join("path", ">")})


@query(f"""WITH RECURSIVE {BOTH}, own AS (SELECT q, src, dst, length FROM lengths, starts), {oracles.settled('own', 'starts', 'found', 10)}
SELECT q AS source, node, round(distance, 6) AS distance, CAST(len(path) - 1 AS BIGINT) AS hops, array_to_string(path, '>') AS path, round(1 / greatest(distance, 0.001), 6) AS path_similarity FROM found""")
def sssp_capped(spark, d):
    edges = paths.clean_edges(_edges(spark, d), both_ways=True)
    return _told(paths.settle(edges, _sources(spark, d), 10)).withColumn("path_similarity", F.round("path_similarity", 6))


@query(f"""WITH RECURSIVE {BOTH}, walk AS (SELECT node_id AS source, node_id AS node, 0.0::DOUBLE AS distance, 0 AS hops FROM nodes WHERE doc_id % 20 = 0
  UNION ALL SELECT w.source, e.dst, w.distance + 1 / e.similarity, w.hops + 1 FROM walk w JOIN both_ways e ON e.src = w.node WHERE w.hops < 3)
  SELECT source, node, round(min(distance), 6) AS distance FROM walk GROUP BY 1, 2""")
def sssp_three_hops(spark, d):
    return nearness.relax(_placed(spark, d), LINK, _sources(spark, d), 3, with_paths=False).select("source", "node", F.round("distance", 6).alias("distance"))


@query(f"WITH RECURSIVE {REACHED} SELECT q AS source, node, round(distance, 6) AS distance, CAST(len(path) - 1 AS INTEGER) AS hops, array_to_string(path, '>') AS path FROM found")
def sssp_full(spark, d):
    return _told(nearness.relax(_placed(spark, d), LINK, _sources(spark, d)))


HOPSET = f"""{BOTH}, ends AS (SELECT DISTINCT src AS node FROM both_ways), chosen AS (SELECT node AS q, node FROM ends ORDER BY md5(node), node LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) FROM ends)),
  {oracles.shortest('lengths', 'chosen', 'near', 3)}, shortcuts AS (SELECT q AS src, node AS dst, distance, CAST(len(path) - 1 AS INTEGER) AS hops FROM near WHERE len(path) - 1 BETWEEN 2 AND 3)"""


@query(f"WITH RECURSIVE {HOPSET} SELECT src, dst, round(distance, 6) AS distance, hops FROM shortcuts")
def hopset(spark, d):
    return nearness.hopset(_placed(spark, d), LINK, 0.2).withColumn("distance", F.round("distance", 6))


@query(f"""WITH RECURSIVE {HOPSET}, more AS (SELECT src, dst, min(length) AS length FROM (SELECT src, dst, length FROM lengths UNION ALL SELECT src, dst, distance FROM shortcuts) GROUP BY 1, 2), {oracles.shortest('more', 'starts', 'found', 2)}
SELECT q AS source, node, round(distance, 6) AS distance FROM found""")
def hopset_relaxation(spark, d):
    return nearness.relax_hopset(_placed(spark, d), LINK, 0.2, _sources(spark, d)).select("source", "node", F.round("distance", 6).alias("distance"))


@query(f"WITH RECURSIVE {REACHED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, node) AS rank FROM found) SELECT q AS source, node, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")
def k_nearest_graph(spark, d):
    edges = paths.clean_edges(_edges(spark, d), both_ways=True)
    return paths.nearest_nodes(edges, _sources(spark, d), 5).select("source", "node", F.round("distance", 6).alias("distance"), "rank")


@query(f"""WITH RECURSIVE {BOTH}, {oracles.shortest('lengths', 'starts', 'found', 4)}, steps AS (SELECT q, node, unnest(path[:-2]) AS src, unnest(path[2:]) AS dst FROM found WHERE len(path) > 1)
SELECT q AS source, node, round(sum(1 / similarity), 9) AS cost, round(avg(similarity), 9) AS average_similarity, round(product(similarity), 9) AS product FROM steps JOIN both_ways USING (src, dst) GROUP BY 1, 2""")
def path_measures(spark, d):
    found = paths.path_product(None, nearness.relax(_placed(spark, d), LINK, _sources(spark, d), 4, with_paths=False, with_similarities=True))
    return found.select("source", "node", *(F.round(c, 9).alias(c) for c in ("cost", "average_similarity", "product")))


# --- pipelines -------------------------------------------------------------------------------------------------------------------------


def _built(least: int) -> str:
    return f"""{NODES}, {oracles.tree(LINK, least_nodes=least)}, {oracles.DOWN}, {oracles.SIBLINGS.format(least=LINK)}, links AS (SELECT src, dst, namespace, edge_type, similarity, round(1 / similarity, 6) AS weight, 1.0::DOUBLE AS confidence FROM down
  UNION ALL SELECT src, dst, NULL, edge_type, similarity, weight, 0.8 FROM siblings)"""


def _fused(start: str, parents: str, down: str) -> str:
    """Ranks of each query over leaves and parents (SQL of node_id, namespace, v, node_type), along similar leaves and from parents down."""
    return f"""WITH RECURSIVE {start}, everything AS (SELECT node_id, namespace, v, 'leaf' AS node_type FROM nodes UNION ALL {parents}),
  scored AS (SELECT q.doc_id AS query_id, n.node_id, n.node_type, round(list_cosine_similarity(q.v, n.v), 6) AS similarity FROM nodes q JOIN everything n ON q.namespace = n.namespace WHERE q.doc_id % 20 = 0),
  hits AS (SELECT * FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, node_id) <= 20) WHERE similarity >= 0.15),
  above AS (SELECT h.query_id, d.src AS node_id, min({{'dst': d.dst, 's': d.similarity}}).s * 0.9 AS similarity FROM hits h JOIN {down} d ON d.dst = h.node_id WHERE NOT EXISTS (SELECT 1 FROM hits x WHERE x.query_id = h.query_id AND x.node_id = d.src) GROUP BY 1, 2),
  known AS (SELECT query_id, node_id, similarity FROM hits UNION ALL SELECT query_id, node_id, similarity FROM above),
  alike AS (SELECT a.node_id AS src, b.node_id AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM nodes a JOIN nodes b ON a.namespace = b.namespace AND a.node_id <> b.node_id),
  graph AS (SELECT src, dst, similarity FROM alike WHERE similarity >= {LINK} UNION ALL SELECT src, dst, similarity FROM {down}),
  inside AS (SELECT a.query_id AS q, g.src, g.dst, 1 / g.similarity AS length FROM graph g JOIN known a ON a.node_id = g.src JOIN known b ON b.node_id = g.dst AND b.query_id = a.query_id),
  begins AS (SELECT query_id AS q, max({{'s': similarity, 'n': node_id}}).n AS node FROM hits WHERE node_type = 'leaf' AND query_id IN (SELECT query_id FROM known GROUP BY 1 HAVING count(*) > 1) GROUP BY 1),
  {oracles.settled('inside', 'begins', 'near', 10)},
  ranks AS (SELECT k.query_id, k.node_id, k.similarity, n.distance, n.path, CASE WHEN b.q IS NULL THEN k.similarity ELSE 0.7 * k.similarity + coalesce(0.3 / (1 + n.distance), 0) END AS score
    FROM known k LEFT JOIN begins b ON b.q = k.query_id LEFT JOIN near n ON n.q = k.query_id AND n.node = k.node_id)
SELECT r.query_id, row_number() OVER (PARTITION BY r.query_id ORDER BY round(score, 9) DESC, r.node_id) AS rank, r.node_id, e.namespace, e.node_type, round(similarity, 6) AS similarity, round(score, 6) AS score, round(distance, 6) AS distance, array_to_string(path, '>') AS path
FROM ranks r JOIN everything e ON e.node_id = r.node_id QUALIFY rank <= 10"""


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "node_id", "namespace", "node_type", *(F.round(c, 6).alias(c) for c in ("similarity", "score", "distance")), F.array_join("path", ">").alias("path"))


def _both_ways(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d).select("src", "dst", "edge_type", "similarity")
    return written(edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})))


@query(_fused(f"{NODES}, down AS (SELECT node_id AS src, node_id AS dst, 0.5 AS similarity FROM nodes WHERE false)", "SELECT node_id, namespace, v, '' FROM nodes WHERE false", "down"))
def search_fused(spark, d):
    """Searches over leaves, along similar ones."""
    nodes = tables.nodes(spark, d)
    return _ranked(api.search(nodes, _both_ways(spark, d), _stated(nodes), limit=10, least=0.15))


@query(_fused(_built(5), "SELECT cluster_id, grp, v, 'parent' FROM tree WHERE depth > 0", "down"))
def search_fused_tree(spark, d):
    """Searches over leaves and the parents of a hierarchy, along similar leaves and from parents to children."""
    leaves = tables.nodes(spark, d)
    parents, down, _ = api.build_hierarchy(leaves, CLUSTERING)
    parents = written(parents.select("node_id", "node_type", "vector", "namespace", "content", "source", "depth_level"))
    down = written(down.filter("edge_type = 'parentchild'").select("src", "dst", "edge_type", "similarity"))
    nodes = leaves.select(*parents.columns).withColumn("vector", F.col("vector").cast("array<double>")).unionByName(parents)
    return _ranked(api.search(nodes, down, _stated(leaves), limit=10, least=0.15, alike=LINK))


ASKED = f"""{NODES}, hits AS (SELECT q.doc_id AS query_id, n.node_id, n.content, n.source, round(list_cosine_similarity(q.v, n.v), 6) AS similarity FROM nodes q JOIN nodes n ON q.namespace = n.namespace WHERE q.doc_id % 20 = 0),
  best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, node_id) AS rank FROM hits), kept AS (SELECT * FROM best WHERE rank <= 5 AND similarity >= {FIND})"""


@query(f"WITH {ASKED} SELECT query_id, count(*) AS n_sources, md5(string_agg('[Source ' || rank || '] (from: ' || source || ', relevance: ' || printf('%.1f', similarity * 100) || '%)' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_digest FROM kept GROUP BY 1")
def ask_context(spark, d):
    nodes = tables.nodes(spark, d)
    return api.ask(nodes, _stated(nodes), least=FIND).select("query_id", "n_sources", F.md5("context").alias("context_digest"))


@query(f"""WITH {ASKED}, told AS (SELECT query_id, string_agg('[Source ' || rank || '] (from: ' || source || ', relevance: ' || printf('%.1f', similarity * 100) || '%)' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n FROM kept GROUP BY 1)
SELECT q.doc_id AS query_id, md5(CASE WHEN context IS NULL THEN 'No relevant information found in the knowledge base.' WHEN n > 3 THEN 'Found ' || n || ' relevant sources:' || chr(10) || chr(10) || context ELSE q.content || ' -> ' || left(context, 200) END) AS answer FROM nodes q LEFT JOIN told ON told.query_id = q.doc_id WHERE q.doc_id % 20 = 0""")
def ask_with_chat(spark, d):
    """Answers by a model that repeats the question and the beginning of its context, and has nothing to say of long ones."""
    nodes = tables.nodes(spark, d)
    questions = nodes.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector", "namespace", F.col("content").alias("question"))
    chat = lambda question, context: F.when(F.size(F.split(context, r"(?m)^\[Source \d+\] ")) <= 4, F.concat(question, F.lit(" -> "), F.left(context, F.lit(200))))
    return api.ask(nodes, questions, least=FIND, chat=chat).select("query_id", F.md5("answer").alias("answer"))


@query("SELECT 'turn_' || conv_id || '_' || turn AS node_id, 'user_' || conv_id AS namespace FROM conversations WHERE trim(text) <> ''")
def remember_episodes(spark, d):
    return api.remember(tables.episodes(spark, d))[0].select("node_id", "namespace")


@query("SELECT * FROM (SELECT 'turn_' || conv_id || '_' || turn AS src, lead('turn_' || conv_id || '_' || turn) OVER (PARTITION BY conv_id ORDER BY turn, 'turn_' || conv_id || '_' || turn) AS dst, 'temporal' AS edge_type FROM conversations) WHERE dst IS NOT NULL")
def temporal_edges(spark, d):
    return tables.temporal_edges(tables.episodes(spark, d))


@query(f"WITH {NODES} SELECT a.node_id AS src, b.node_id AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS similarity, 'crossnamespace' AS edge_type FROM nodes a JOIN nodes b ON a.namespace <> b.namespace AND a.node_id < b.node_id WHERE round(list_cosine_similarity(a.v, b.v), 6) >= {LINK}")
def cross_namespace_links(spark, d):
    return api.cross_links(tables.nodes(spark, d), LINK).select("src", "dst", "similarity", "edge_type")


@query(f"WITH {NODES} SELECT node_id, CASE WHEN doc_id % 10 = 0 THEN 'deprecated' WHEN doc_id % 10 = 1 THEN 'complete' ELSE status END AS status, CASE WHEN doc_id % 10 = 0 THEN 'deprecated' WHEN doc_id % 10 = 1 THEN 'content,status' ELSE '' END AS updated FROM nodes")
def memory_update(spark, d):
    nodes = tables.nodes(spark, d)
    k = F.col("doc_id") % 10
    changes = nodes.filter(k < 2).select("node_id", F.when(k == 1, "new").alias("content"), F.when(k == 1, "complete").alias("status"), F.lit(None).cast("array<string>").alias("tags"), F.when(k == 0, F.lit(True)).alias("deprecated"))
    return api.update_nodes(nodes, changes).select("node_id", "status", F.array_join("updated_fields", ",").alias("updated"))


@query("SELECT CAST(count(DISTINCT text) AS BIGINT) AS nodes, CAST(count(DISTINCT text) AS BIGINT) AS complete FROM documents WHERE trim(text) <> ''")
def ingest_nodes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    found = api.ingest_documents(docs, lambda c: F.array(F.length(c).cast("double")), chunk=False)
    return found.agg(F.count_distinct("node_id").alias("nodes"), F.count_if(F.col("status") == "complete").alias("complete"))


@query(f"""WITH RECURSIVE chunks AS ({oracles.chunks(1000, 200, 100, chunk.LOOK_BACK, chunk.LOOK_AHEAD, chunk.BREAKS)}), whole AS (SELECT c.*, d.source FROM chunks c JOIN documents d USING (doc_id) WHERE trim(d.text) <> ''),
once AS (SELECT content, min({{'doc_id': doc_id, 'chunk_index': chunk_index, 'total': total, 'source': source}}) AS p FROM whole GROUP BY 1)
SELECT left(sha256(CAST(to_json({{'n': 'global_knowledge', 'c': content}}) AS VARCHAR)), 32) AS node_id, p.doc_id, p.source, 'chunk:' || (p.chunk_index + 1) || '/' || p.total AS tag, 4 AS dimension, md5(content) AS digest FROM once""")
def ingest_chunked(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    found = api.ingest_documents(docs, lambda c: F.array_repeat(F.length(c).cast("double"), 4))
    return found.select("node_id", "doc_id", "source", F.array_join("tags", ",").alias("tag"), F.size("vector").alias("dimension"), F.md5("content").alias("digest"))


#: The mock provider's answers to a question q, put together: addresses, and what is said of each.
SITES = "sites AS (SELECT unnest(['Wikipedia', 'Stack Overflow', 'GitHub', 'Documentation', 'Blog Post']) AS site, unnest(['https://en.wikipedia.org', 'https://stackoverflow.com', 'https://github.com', 'https://docs.rs', 'https://medium.com']) AS base, unnest([0, 1, 2, 3, 4]) AS p)"


@query(rf"""WITH {NODES}, {SITES}, asked AS (SELECT node_id, content, array_to_string(list_slice(list_filter(regexp_split_to_array(substring(content, 1, 100), '\s+'), lambda x: x <> ''), 1, 10), ' ') AS q FROM nodes WHERE status = 'incomplete'),
told AS (SELECT node_id, content, q, site, p, base || '/search?q=' || replace(q, ' ', '+') AS url FROM asked, sites WHERE trim(q) <> '')
SELECT node_id AS related_to, count(*) AS n_sources, md5('# Synthesized Knowledge' || chr(10) || chr(10) || '**Original Query:** ' || any_value(content) || chr(10) || chr(10) || '**Sources:**' || chr(10) || string_agg('- ' || url, chr(10) ORDER BY p) || chr(10) || chr(10) || '**Combined Information:**' || chr(10)
  || string_agg('• ' || site || ' - ' || q || ' (' || url || ')' || chr(10) || 'This is a mock search result for ' || chr(39) || q || chr(39) || '. It contains relevant information about the topic and provides context for the REM phase synthesis.', chr(10) || chr(10) ORDER BY p)) AS digest FROM told GROUP BY 1""")
def synthesize(spark, d):
    rows = tables.nodes(spark, d).filter("status = 'incomplete'").select("node_id", "content")
    return api.synthesize(rows).select("related_to", "n_sources", F.md5("content").alias("digest"))


@query(f"""WITH RECURSIVE {_built(3)}, p AS (SELECT grp AS namespace, count(*) AS parents FROM tree WHERE depth > 0 GROUP BY 1), e AS (SELECT namespace, count(*) AS made FROM links WHERE namespace IS NOT NULL GROUP BY 1)
SELECT namespace, count(*) AS nodes_processed, coalesce(any_value(parents), 0) AS parents_created, coalesce(any_value(made), 0) AS edges_created FROM nodes LEFT JOIN p USING (namespace) LEFT JOIN e USING (namespace) GROUP BY namespace""")
def consolidate(spark, d):
    return api.consolidate(tables.nodes(spark, d), CLUSTERING, link_least=LINK)["report"]


@query(f"WITH RECURSIVE {_built(5)} SELECT * FROM links")
def build_hierarchy(spark, d):
    return api.build_hierarchy(tables.nodes(spark, d), CLUSTERING)[1]


@query("SELECT count(*) AS performed, count(*) FILTER (WHERE event_id % 5 <> 0) AS successful, sum(CASE WHEN event_id % 5 <> 0 THEN event_id % 7 END)::BIGINT AS total_results, CAST(floor(sum(CASE WHEN event_id % 5 <> 0 THEN user_id END) / count(*) FILTER (WHERE event_id % 5 <> 0)) AS BIGINT) AS average_latency_ms FROM events")
def search_stats(spark, d):
    rows = table(spark, d, "events").select((F.col("event_id") % 5 != 0).alias("ok"), (F.col("event_id") % 7).alias("results"), F.col("user_id").alias("latency_ms"))
    return api.search_stats(rows)


@query(f"WITH {MODEL_NODES} SELECT id, level, coalesce(CASE WHEN level = 1 THEN 'root' END, parent_id) AS parent_id FROM model_nodes ORDER BY level, id")
def update_parents(spark, d):
    nodes = tables.model_nodes(spark, d)
    new = nodes.filter("level = 1").select(F.col("id").alias("child"), F.lit("root").alias("parent"))
    return api.update_parents(nodes, new).select("id", "level", "parent_id").orderBy("level", "id")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS written, true AS read_back FROM events")
def rfc3339(spark, d):
    at = F.col("ts")
    return table(spark, d, "events").select("event_id", rules.rfc3339(at).alias("written"), (rules.to_time(rules.rfc3339(at)) == F.date_trunc("millisecond", at)).alias("read_back"))


@query(f"""WITH RECURSIVE {REACHED}, wanted AS (SELECT s.q, n.node_id AS node FROM starts s JOIN nodes n ON n.doc_id % 7 = 3)
SELECT w.q AS source, w.node AS target, round(distance, 6) AS distance, array_to_string(path, '>') AS path FROM wanted w LEFT JOIN found f ON f.q = w.q AND f.node = w.node""")
def paths_to_targets(spark, d):
    """Of pairs within a namespace the search says whether there is a path; between namespaces there is none."""
    ends = tables.nodes(spark, d).select("node_id", F.coalesce("namespace", F.lit("")).alias("space"), "doc_id")
    part = lambda where, name: written(ends.filter(where).select(F.col("node_id").alias(name), F.col("space").alias(f"{name}_space")))
    sources, targets = part("doc_id % 20 = 0", "source"), part("doc_id % 7 = 3", "target")
    found = nearness.relax(_placed(spark, d), LINK, sources.select("source"), targets=targets.select(F.col("target").alias("node"))).select("source", F.col("node").alias("target"), "distance", "path")
    apart = sources.join(targets, F.col("source_space") != F.col("target_space")).select("source", "target", F.lit(None).cast("double").alias("distance"), F.lit(None).cast("array<string>").alias("path"))
    return _told(found.unionByName(apart))


@query(f"""WITH RECURSIVE {TREE}, scored AS (SELECT grp, cluster_id, round(list_cosine_similarity(v, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM tree WHERE depth = 0)
SELECT grp AS "group", cluster_id, similarity FROM scored QUALIFY row_number() OVER (PARTITION BY grp ORDER BY similarity DESC, cluster_id) = 1""")
def similar_leaf(spark, d):
    return cluster.similar_leaf(_tree(spark, d), _vector(spark, d))
