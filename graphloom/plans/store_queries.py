"""Registered queries of the store, files, model files, schedules and small rules, each beside its SQL."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import scratch, written
from graphloom.config import CacheSettings, ChatSettings, EmbeddingSettings, IngestionSettings, RemSettings, StoreSettings
from graphloom.errors import Conflict, EngineError, InvalidRequest, NotFound, ProviderFailed, StoreFailed, TooLarge, Unavailable
from graphloom.functions import rules, text, vectors
from graphloom.operators import chunk, paths, search
from graphloom.plans import api, oracles
from graphloom.plans.queries import CLUSTERING, EDGES, LINK, MODEL_NODES, NODES, _built, _edges
from graphloom.plans.registered import Registered
from graphloom.providers import SEARCHES, Brain
from graphloom.sources import gguf, tables
from graphloom.sources.repository import Repository
from graphloom.sources.tables import table
from graphloom.streaming import schedule, uploads

query = Registered()


def queries() -> dict:
    return dict(query.queries)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)


def _store(spark: SparkSession) -> Repository:
    store = Repository(spark, scratch(spark))
    store.initialise()
    return store


def _node_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.nodes(spark, d)
    vector = F.struct(F.col("vector"), F.lit("test").alias("model"), F.size("vector").alias("dimension")).alias("embedding")
    meta = {"source": F.col("source"), "source_type": F.lit("text"), "source_url": None, "author": None, "tags": F.col("tags"), "language": F.col("language"), "access_count": F.lit(0).cast("long")}
    metadata = F.struct(*((F.lit(None).cast("string") if x is None else x).alias(k) for k, x in meta.items())).alias("metadata")
    return rows.select("doc_id", "node_id", "node_type", "status", "content", vector, "depth_level", "confidence", "namespace", metadata)


# --- store -----------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {NODES} SELECT 'global_knowledge' AS name, 'global' AS namespace_type, CAST(1 AS BIGINT) AS n, true AS healthy, count(*) AS nodes FROM nodes")
def store_initialised(spark, d):
    """A store that is initialised again after nodes were added: they stay, and the global namespace is there once."""
    store = _store(spark)
    store.append("nodes", _node_rows(spark, d))
    store.initialise()
    healthy, nodes = store.healthy(), store.read("nodes").count()
    return store.read("namespaces").groupBy("name", "namespace_type").agg(F.count("*").alias("n")).withColumns({"healthy": F.lit(healthy), "nodes": F.lit(nodes).cast("long")})


@query(f"WITH {NODES} SELECT node_id, namespace, CASE WHEN status = 'pending' THEN 'complete' ELSE status END AS status, CAST(len(v) AS INTEGER) AS dimension, source FROM nodes WHERE status <> 'deprecated'")
def store_nodes(spark, d):
    """Nodes created in two writes, then updated and deleted."""
    store, rows = _store(spark), _node_rows(spark, d)
    store.append("nodes", rows.filter("doc_id % 2 = 0"))
    store.append("nodes", rows.filter("doc_id % 2 = 1"))
    store.update("nodes", F.col("status") == "pending", status=F.lit("complete"))
    store.delete("nodes", F.col("status") == "deprecated")
    return store.read("nodes").select("node_id", "namespace", "status", "embedding.dimension", "metadata.source")


@query(f"WITH {NODES} SELECT node_id, md5(content) AS digest FROM nodes WHERE node_id = '7'")
def store_node_by_id(spark, d):
    store = _store(spark)
    store.append("nodes", _node_rows(spark, d))
    return store.get("nodes", "7").select("node_id", F.md5("content").alias("digest"))


@query(f"WITH {NODES} SELECT 0 AS version, CAST(0 AS BIGINT) AS n UNION ALL SELECT 1, count(*) FILTER (WHERE doc_id % 2 = 0) FROM nodes UNION ALL SELECT 2, count(*) FROM nodes UNION ALL SELECT 3, count(*) FILTER (WHERE status <> 'pending') FROM nodes")
def store_versions(spark, d):
    """What each version of a table holds: earlier ones stay readable."""
    store, rows = _store(spark), _node_rows(spark, d)
    store.append("nodes", rows.filter("doc_id % 2 = 0"))
    store.append("nodes", rows.filter("doc_id % 2 = 1"))
    store.delete("nodes", F.col("status") == "pending")
    found = [store.read("nodes", v).agg(F.lit(v).alias("version"), F.count("*").alias("n")) for v in store.versions("nodes")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(f"WITH {EDGES} SELECT src, dst, similarity, false AS any_before, true AS any_after FROM edges WHERE CAST(src AS BIGINT) % 2 = 1")
def store_edges(spark, d):
    store = _store(spark)
    before = store.exists("edges")
    store.append("edges", _edges(spark, d))
    after = store.exists("edges")
    store.delete("edges", F.col("src").cast("long") % 2 == 0)
    return store.read("edges").select("src", "dst", F.round(F.col("similarity").cast("double"), 6).alias("similarity"), F.lit(before).alias("any_before"), F.lit(after).alias("any_after"))


@query(f"""WITH {MODEL_NODES}, m AS (SELECT 'fractal_models:' || r_regionkey AS id, r_name AS name, CASE r_regionkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'converting' ELSE 'failed' END AS status FROM region WHERE r_regionkey <> 1)
SELECT id, name, CASE WHEN id = 'fractal_models:4' THEN 'ready' ELSE status END AS status, (SELECT count(*) FROM model_nodes n WHERE n.model_id = m.id) AS nodes FROM m""")
def store_models(spark, d):
    """Models and their nodes created, one model replaced, another deleted with its nodes."""
    store, models = _store(spark), tables.models(spark, d).select("id", "name", "status", "root_node_id", "created_at")
    store.append("models", models)
    store.append("model_nodes", tables.model_nodes(spark, d).withColumnRenamed("vector", "embedding"))
    again = models.filter("id = 'fractal_models:4'")
    store.upsert("models", again.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp")).unionByName(again.withColumns({"status": F.lit("ready"), "updated_at": F.lit("2024-01-02").cast("timestamp")})), "id")
    store.delete_model("fractal_models:1")
    nodes = store.read("model_nodes").groupBy(F.col("model_id").alias("id")).agg(F.count("*").alias("nodes"))
    return store.read("models").join(nodes, "id", "left").select("id", "name", "status", F.coalesce("nodes", F.lit(0)).alias("nodes"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS upload_id, CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'finalizing' ELSE 'uploading' END ELSE 'converting' END AS status FROM orders WHERE o_orderstatus <> 'F'")
def store_sessions(spark, d):
    """Sessions stored, some replaced, and the active ones read back."""
    store = _store(spark)
    rows = tables.sessions(spark, d).select(F.col("upload_id").cast("string").alias("upload_id"), "total_chunks", "status", "created_at")
    store.append("upload_sessions", rows)
    store.upsert("upload_sessions", uploads.move(rows.filter("cast(upload_id as long) % 5 = 0"), "finalizing"), "upload_id")
    return uploads.active(store.read("upload_sessions")).select("upload_id", "status")


STORED = f"""WITH RECURSIVE {_built(5)}, parents AS (SELECT cluster_id AS node_id, grp AS namespace, depth, text FROM tree WHERE depth > 0)"""


@query(f"{STORED} SELECT node_id, namespace, depth AS depth_level, CASE WHEN length(text) > 1000 THEN md5(left(text, 1000) || '...') ELSE md5(text) END AS digest, (SELECT count(*) FROM links WHERE src = node_id AND edge_type = 'parentchild') AS below FROM parents")
def store_hierarchy(spark, d):
    """A hierarchy stored twice: the second build replaces the first."""
    store = _store(spark)
    for _ in range(2):
        api.store_hierarchy(store, tables.nodes(spark, d), CLUSTERING)
    below = store.read("edges").filter("edge_type = 'parentchild'").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("below"))
    return store.read("nodes").join(below, "node_id").select("node_id", "namespace", "depth_level", F.md5("content").alias("digest"), "below")


@query("SELECT CAST(k AS INTEGER) AS k, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'healthy' WHEN k % 2 = 0 OR k % 3 = 0 THEN 'degraded' ELSE 'unhealthy' END AS status FROM (SELECT n_nationkey AS k FROM nation)")
def health_states(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.cast("int").alias("k"), rules.health(k % 2 == 0, k % 3 == 0).alias("status"))


@query(f"WITH {NODES}, h AS (SELECT 'no' AS store, 'healthy' AS status, true AS database, true AS llm UNION ALL SELECT 'good', 'degraded', true, false UNION ALL SELECT 'bad', 'degraded', false, true) SELECT h.*, CASE WHEN store = 'good' THEN (SELECT count(*) FROM nodes) END AS nodes FROM h")
def store_health(spark, d):
    """Health with a store that answers, and with one below a file, which can't."""
    good, base = Repository(spark, scratch(spark)), scratch(spark)
    spark.range(1).coalesce(1).write.parquet(base)
    file = next(x.getPath().toString() for x in good._path(base).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(base)) if x.getPath().getName().endswith(".parquet"))
    rows = [("no", None, True), ("good", good, False), ("bad", Repository(spark, f"{file}/below"), True)]
    found = [api.system_health(spark, s, m).select(F.lit(n).alias("store"), "status", "database", "llm") for n, s, m in rows]
    good.initialise()
    good.append("nodes", _node_rows(spark, d))
    held = good.read("nodes").agg(F.lit("good").alias("store"), F.count("*").alias("nodes"))
    return found[0].unionByName(found[1]).unionByName(found[2]).join(held, "store", "left")


@query("""WITH s AS (SELECT c_custkey, c_custkey % 2 = 0 AS w, c_custkey % 3 = 0 AS d, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 11 AS INTEGER)) END AS ends FROM customer),
e AS (SELECT *, coalesce(TIMESTAMP '2024-01-06' > ends, false) AS expired FROM s) SELECT c_custkey, expired, w AND NOT expired AS can_write, d AND NOT expired AS can_delete FROM e""")
def scope_rights(spark, d):
    k = F.col("c_custkey")
    ends = F.when(k % 4 != 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(k % 11).cast("int")))
    rows = table(spark, d, "customer").select(k, F.struct((k % 2 == 0).alias("write"), (k % 3 == 0).alias("delete")).alias("p"), ends.alias("ends"))
    now = F.lit("2024-01-06").cast("timestamp")
    return rows.select("c_custkey", rules.is_expired(F.col("ends"), now).alias("expired"), rules.can_write(F.col("p"), F.col("ends"), now).alias("can_write"), rules.can_delete(F.col("p"), F.col("ends"), now).alias("can_delete"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'nodes' WHEN 1 THEN 'edges' END AS tbl, CASE n_nationkey % 3 WHEN 2 THEN NULL ELSE CAST(n_nationkey AS VARCHAR) END AS id FROM nation")
def thing_parsed(spark, d):
    k = F.col("n_nationkey")
    thing = F.concat(F.when(k % 3 == 0, "").when(k % 3 == 1, "edges:").otherwise("a:b:"), k.cast("string"))
    pair = rules.thing_pair(thing)
    return table(spark, d, "nation").select("n_nationkey", pair["table"].alias("tbl"), pair["id"].alias("id"))


# --- model files -----------------------------------------------------------------------------------------------------------------------

_TEXT = lambda x: struct.pack("<Q", len(x)) + x.encode()


def _file(region: int) -> bytes:
    """A model file of 12 + region layers of two tensors with region + 1 rows each, and one tensor outside of the layers; the third region's lacks its layers' number."""
    layers = 12 + region
    keys = {"llama.block_count": layers, "llama.embedding_length": 8, "llama.attention.head_count": 2, "llama.feed_forward_length": 16}
    if region == 3:
        del keys["llama.block_count"]
    names = ["token_embd.weight", *(f"blk.{k}.{x}" for k in range(layers) for x in ("attn_q.weight", "ffn_up.weight"))]
    values = np.arange(4 * (region + 1), dtype="<f4").tobytes()
    head = _TEXT("general.architecture") + struct.pack("<I", 8) + _TEXT("llama") + b"".join(_TEXT(k) + struct.pack("<II", 4, v) for k, v in keys.items())
    for place, name in enumerate(names):
        head += _TEXT(name) + struct.pack("<I", 2) + struct.pack("<2Q", 4, region + 1) + struct.pack("<IQ", 0, place * len(values))
    head = b"GGUF" + struct.pack("<IQQ", 3, len(names), len(keys) + 1) + head
    return head + b"\0" * (-len(head) % 32) + values * len(names)


def _model_files(spark: SparkSession, d: str) -> str:
    """The folder of the regions' model files, which arrive in chunks of 1,000 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                data = _file(k)
                parts = [data[at : at + 1000] for at in range(0, len(data), 1000)]
                yield pa.RecordBatch.from_arrays([pa.array([f"m{k}"] * len(parts)), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], ["upload_id", "chunk", "data"])

    folder = scratch(spark)
    uploads.assemble(table(spark, d, "region").select("r_regionkey").mapInArrow(run, "upload_id string, chunk long, data binary"), folder, 1000, ".gguf")
    return folder


def _tensors(spark: SparkSession, d: str) -> DataFrame:
    """The tensors of the regions' model files, files by their names."""
    return gguf.read_models(spark, _model_files(spark, d), tensors=10).withColumn("path", F.element_at(F.split("path", "/"), -1))


@query("SELECT 'm' || r_regionkey || '.gguf' AS path, CASE WHEN r_regionkey = 3 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN r_regionkey = 3 THEN NULL ELSE 12 + r_regionkey END AS n_layers, CASE WHEN r_regionkey = 3 THEN NULL ELSE 32000 END AS vocab_size, CASE WHEN r_regionkey = 3 THEN 0 ELSE 2 * (12 + r_regionkey) + 1 END AS tensors, CASE WHEN r_regionkey = 3 THEN NULL ELSE (2 * (12 + r_regionkey) + 1) * 4 * (r_regionkey + 1) END AS total_params FROM region")
def gguf_models(spark, d):
    rows = _tensors(spark, d)
    size = F.aggregate("dimensions", F.lit(1).cast("long"), lambda a, x: a * x)
    status = F.when(F.max("error").isNull(), "ready").otherwise("failed")
    found = rows.groupBy("path").agg(status.alias("status"), F.max("architecture.n_layers").alias("n_layers"), F.max("architecture.vocab_size").alias("vocab_size"), F.count("tensor").alias("tensors"), F.sum(size).alias("total_params"))
    return found.select("path", "status", "n_layers", "vocab_size", "tensors", "total_params")


LAYERS = """l AS (SELECT r_regionkey AS r, 12 + r_regionkey AS layers, unnest(range(0, 12 + r_regionkey)) AS k FROM region WHERE r_regionkey <> 3),
groups AS (SELECT 'm' || r || '.gguf' AS path, k // (layers // 6) * (layers // 6) AS layer_start, min(least(k // (layers // 6) * (layers // 6) + layers // 6 - 1, layers - 1)) AS layer_end, 'transformer' AS layer_type, 2 * count(*) AS tensors, 2 * count(*) * 4 * (any_value(r) + 1) AS total_params FROM l GROUP BY 1, 2
  UNION ALL SELECT 'm' || r_regionkey || '.gguf', 0, 0, 'embedding', 1, 4 * (r_regionkey + 1) FROM region WHERE r_regionkey <> 3)"""


@query(f"WITH {LAYERS} SELECT path, CAST(layer_start AS INTEGER) AS layer_start, CAST(layer_end AS INTEGER) AS layer_end, layer_type, CAST(tensors AS BIGINT) AS tensors, CAST(total_params AS BIGINT) AS total_params FROM groups")
def gguf_layer_groups(spark, d):
    found = gguf.layer_groups(_tensors(spark, d))
    return found.select("path", "layer_start", "layer_end", "layer_type", "tensors", "total_params")


@query("""WITH t AS (SELECT r_regionkey AS r, unnest(range(0, 2 * (12 + r_regionkey) + 1)) AS place FROM region WHERE r_regionkey <> 3),
n AS (SELECT r, place, CASE WHEN place = 0 THEN 'token_embd.weight' ELSE 'blk.' || ((place - 1) // 2) || CASE WHEN place % 2 = 1 THEN '.attn_q.weight' ELSE '.ffn_up.weight' END END AS tensor FROM t),
g AS (SELECT r, n.tensor, n.place, CASE WHEN place = 0 THEN -1 ELSE (place - 1) // 2 // ((12 + r) // 6) END AS grp FROM n),
s AS (SELECT r, grp, (31 * i + strlen(tensor)) % 16 AS spot, CAST(i AS DOUBLE) AS x FROM g, range(0, 24) x(i) WHERE i < 4 * (r + 1)),
c AS (SELECT r, grp, count(*) AS n FROM s GROUP BY 1, 2), f AS (SELECT r, grp, spot, sum(x) / sqrt(any_value(n)) AS x FROM s JOIN c USING (r, grp) GROUP BY 1, 2, 3),
u AS (SELECT r, grp, spot, x / sqrt(sum(x * x) OVER (PARTITION BY r, grp)) AS x FROM f)
SELECT 'm' || r || '.gguf' AS path, CAST(CASE WHEN grp < 0 THEN 0 ELSE grp * ((12 + r) // 6) END AS INTEGER) AS layer_start, CASE WHEN grp < 0 THEN 'embedding' ELSE 'transformer' END AS layer_type, CAST(spot AS INTEGER) AS place, round(x, 6) AS x FROM u WHERE abs(x) > 1e-9""")
def gguf_folded(spark, d):
    """The folded samples of each group of layers."""
    found = gguf.group_vectors(gguf.layer_groups(_tensors(spark, d)), 16)
    return found.select("path", "layer_start", "layer_type", F.posexplode("vector").alias("place", "x")).withColumn("x", F.round("x", 6)).filter("abs(x) > 1e-9")


@query("SELECT 'm' || r_regionkey || '.gguf' AS id, CASE WHEN r_regionkey = 3 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN r_regionkey = 3 THEN 0.0 ELSE 100.0 END AS progress, r_regionkey <> 3 AS has_root, r_regionkey <> 3 AS all_linked FROM region")
def model_convert(spark, d):
    """Model files converted and stored, twice; whether each has a root and every node's parent is there."""
    store, files = _store(spark), _model_files(spark, d)
    for _ in range(2):
        api.store_models(store, files, 64)
    nodes = store.read("model_nodes").withColumn("model_id", F.element_at(F.split("model_id", "/"), -1))
    up = nodes.select(F.col("id").alias("up"), F.col("model_id").alias("m"))
    linked = nodes.join(up, (F.col("parent_id") == F.col("up")) & (F.col("model_id") == F.col("m")), "left").groupBy("model_id").agg(F.bool_or(F.col("parent_id").isNull()).alias("has_root"), (F.bool_and(F.col("parent_id").isNull() | F.col("up").isNotNull()) & (F.count("*") == F.count_distinct("id"))).alias("all_linked"))
    found = store.read("models").join(linked, F.col("name") == F.col("model_id"), "left")
    return found.select(F.col("name").alias("id"), "status", F.col("conversion_progress").cast("double").alias("progress"), F.coalesce("has_root", F.lit(False)).alias("has_root"), F.coalesce("all_linked", F.lit(False)).alias("all_linked"))


#: Types of the parts' tensors: F32, F16, BF16, blocks of 8 and of 4 bits.
PART_TYPES, PART_BYTES = (0, 1, 30, 8, 2), (128, 64, 64, 64, 32)


def _part_models(spark: SparkSession, d: str) -> str:
    """The folder of model files of 200 parts each, a tensor of 32 values for each part, of five types; the values follow from the part's size. The header is a chunk, and each 50 tensors are one."""

    def data(kind: int, size: int) -> bytes:
        v = (size + np.arange(32)) % 16 - 8
        if kind == 8:
            out = struct.pack("<e", 0.5) + v.astype(np.int8).tobytes()
        elif kind == 2:
            out = struct.pack("<e", 2.0) + ((v[::2] + 8) | (v[1::2] + 8) << 4).astype(np.uint8).tobytes()
        elif kind == 30:
            out = (v.astype("<f4").view("<u4") >> 16).astype("<u2").tobytes()
        else:
            out = v.astype("<f2" if kind == 1 else "<f4").tobytes()
        return out.ljust(PART_BYTES[PART_TYPES.index(kind)], b"\0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model, parts in zip(batch.column("model").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                head = _TEXT("general.architecture") + struct.pack("<I", 8) + _TEXT("llama") + b"".join(_TEXT(f"llama.{k}") + struct.pack("<II", 4, 40) for k in ("block_count", "embedding_length", "attention.head_count", "feed_forward_length"))
                at = 0
                for p in parts:
                    kind = p["p_partkey"] % 5
                    head += _TEXT(f"blk.{p['p_partkey'] % 40}.part{p['p_partkey']}") + struct.pack("<I", 1) + struct.pack("<Q", 32) + struct.pack("<IQ", PART_TYPES[kind], at)
                    at += PART_BYTES[kind]
                head = b"GGUF" + struct.pack("<IQQ", 3, len(parts), 5) + head
                chunks = [head + b"\0" * (-len(head) % 32)] + [b"".join(data(PART_TYPES[p["p_partkey"] % 5], p["p_size"]) for p in parts[k : k + 50]) for k in range(0, len(parts), 50)]
                yield pa.RecordBatch.from_arrays([pa.array([f"parts{model}"] * len(chunks)), pa.array(range(len(chunks)), pa.int64()), pa.array(chunks, pa.binary())], ["upload_id", "chunk", "data"])

    grouped = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 200).alias("model")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))).alias("parts"))  # 200 at most
    folder = scratch(spark)
    uploads.assemble(grouped.mapInArrow(run, "upload_id string, chunk long, data binary"), folder, suffix=".gguf")
    return folder


@query("""WITH v AS (SELECT p_partkey, CAST(p_partkey % 5 AS INTEGER) AS kind, i, (p_size + i) % 16 - 8 AS v FROM part, range(0, 32) x(i)),
s AS (SELECT p_partkey, kind, i, CASE kind WHEN 3 THEN 0.5 WHEN 4 THEN 2.0 ELSE 1.0 END * v AS x FROM v WHERE kind < 3 OR i < 8)
SELECT 'parts' || (p_partkey // 200) || '.gguf' AS path, 'blk.' || (p_partkey % 40) || '.part' || p_partkey AS tensor, CAST(CASE any_value(kind) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 30 WHEN 3 THEN 8 ELSE 2 END AS BIGINT) AS tensor_type, CAST(count(*) AS INTEGER) AS samples, CAST(sum(x) AS DOUBLE) AS total, CAST(sum(x * i) AS DOUBLE) AS weighted FROM s GROUP BY p_partkey""")
def gguf_quantized(spark, d):
    """Samples of tensors of five types, in files that were uploaded in chunks and are read by ranges of tensors."""
    x = F.transform("samples", lambda v, i: v * i)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    rows = gguf.read_models(spark, _part_models(spark, d), tensors=64)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("path"), "tensor", "tensor_type", F.size("samples").alias("samples"), total("samples").alias("total"), total(x).alias("weighted"))


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN n_nationkey WHEN 1 THEN n_nationkey WHEN 2 THEN n_nationkey WHEN 3 THEN NULL ELSE 7 END AS layer FROM nation")
def layer_numbers(spark, d):
    k = F.col("n_nationkey")
    n = k.cast("string")
    name = F.when(k % 5 == 0, F.concat(F.lit("blk."), n, F.lit(".attn"))).when(k % 5 == 1, F.concat(F.lit("model.layers."), n, F.lit(".mlp"))).when(k % 5 == 2, F.concat(F.lit("transformer.h."), n, F.lit(".x"))).when(k % 5 == 3, F.concat(F.lit("output.norm"), n)).otherwise(F.lit("blk.x.layers.7.q"))
    return table(spark, d, "nation").select("n_nationkey", rules.layer_number(name).alias("layer"))


@query("""SELECT 'fractal_models:' || r_regionkey AS id, CASE WHEN r_regionkey = 2 THEN 'ready' ELSE CASE r_regionkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'converting' ELSE 'failed' END END AS status, r_regionkey = 2 AS touched FROM region""")
def model_status_update(spark, d):
    models = tables.models(spark, d).select("id", "status", F.lit(None).cast("timestamp").alias("updated_at"))
    return api.update_model(models, "fractal_models:2", status="ready").select("id", "status", F.col("updated_at").isNotNull().alias("touched"))


# --- files and uploads -----------------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Pages as uploaded files of five kinds: text with odd white space, Markdown, PDF, a kind that isn't allowed, and empty ones."""
    k = F.col("page_id") % 5
    name = F.concat(F.lit("in/"), F.col("page_id").cast("string"), F.when(k == 0, ".txt").when(k == 1, ".MD").when(k == 2, ".pdf").when(k == 3, ".zip").otherwise(".txt"))
    body = F.when(k == 4, "").otherwise(F.concat("html", F.lit("\r\n\t end")))
    tags = F.when(F.col("page_id") % 3 == 0, '["a","b"]').when(F.col("page_id") % 3 == 1, "one").otherwise("")
    return table(spark, d, "pages").select(name.alias("path"), F.octet_length(body).cast("long").alias("length"), F.encode(body, "UTF-8").alias("content"), tags.alias("tags"), F.lit("en").alias("language"))


FILES = """files AS (SELECT page_id, 'in/' || page_id || CASE page_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.pdf' WHEN 3 THEN '.zip' ELSE '.txt' END AS path, CASE WHEN page_id % 5 = 4 THEN '' ELSE html || chr(13) || chr(10) || chr(9) || ' end' END AS body FROM pages)"""


@query(f"WITH {FILES} SELECT path, CASE WHEN body = '' THEN 'empty' WHEN strlen(body) > 4000 THEN 'too large' WHEN page_id % 5 = 3 THEN 'type not allowed' END AS refused FROM files")
def file_gates(spark, d):
    return api.file_gates(_files(spark, d), IngestionSettings(max_file_size=4000)).select("path", "refused")


SQUEEZED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace({}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[^\S\n]+', ' ', 'g'), '\n\s*', chr(10), 'g'), '^\s+', '', 'g'), '\s+$', '', 'g')"


@query(f"WITH {FILES}, t AS (SELECT *, {SQUEEZED.format('body')} AS text FROM files WHERE page_id % 5 < 2), n AS (SELECT text, min(path) AS path FROM t GROUP BY 1) SELECT n.path, md5(n.text) AS digest, CASE page_id % 3 WHEN 0 THEN 'a,b,' WHEN 1 THEN 'one,' ELSE '' END || 'chunk:1/1' AS tags, 'en' AS language FROM n JOIN t USING (path)")
def ingest_files(spark, d):
    nodes, _ = api.ingest_files(_files(spark, d), api.default_embedder(4), size=1 << 20)
    return nodes.select(F.col("source").alias("path"), F.md5("content").alias("digest"), F.array_join("tags", ",").alias("tags"), "language")


@query(f"WITH {FILES} SELECT path, CASE page_id % 5 WHEN 2 THEN 'pdf' WHEN 3 THEN 'unknown' ELSE 'text' END AS file_type, CASE WHEN body = '' THEN 'empty' WHEN page_id % 5 = 3 THEN 'type not allowed' WHEN page_id % 5 = 2 THEN 'no decoder for this type' END AS warning FROM files")
def ingest_report(spark, d):
    return api.ingest_files(_files(spark, d), api.default_embedder(4), size=1 << 20)[1]


MAGICS = "magics AS (SELECT page_id, page_id % 7 AS k FROM pages)"


@query(f"WITH {MAGICS} SELECT page_id, CASE k WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'bmp' END AS image, k = 5 AS pdf FROM magics")
def sniffed_types(spark, d):
    k = F.col("page_id") % 7
    heads = ("89504E470D0A", "FFD8FFE000", "4749463839", "52494646AAAAAAAA57454250", "424D0000", "255044462D31", "68656C6C6F")
    head = F.unhex(F.get(F.array(*(F.lit(x) for x in heads)), k.cast("int")))
    return table(spark, d, "pages").select("page_id", text.sniff_image(head).alias("image"), rules.is_pdf(head).alias("pdf"))


@query(r"""WITH t AS (SELECT page_id, chr(7) || html || chr(65533) || chr(27) || ' x  y ' AS body FROM pages)
SELECT page_id, md5(regexp_replace(""" + SQUEEZED.format("body").replace("replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10))", "body") + r""", '[\x00-\x08\x0b-\x1f\x7f-\x{9f}]', '', 'g')) AS pdf, md5(replace(regexp_replace(""" + SQUEEZED.format("body").replace("replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10))", "body") + r""", '[\x00-\x08\x0b-\x1f\x7f-\x{9f}]', '', 'g'), chr(65533), '')) AS ocr FROM t""")
def cleaned_extracts(spark, d):
    body = F.concat(F.lit("\x07"), "html", F.lit("�\x1b x  y "))
    return table(spark, d, "pages").select("page_id", F.md5(text.clean_extracted(body)).alias("pdf"), F.md5(text.clean_extracted(body, True)).alias("ocr"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS upload_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 10 END AS length, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS whole FROM orders")
def partial_uploads(spark, d):
    k = F.col("o_orderkey")
    files = table(spark, d, "orders").select(F.concat(F.lit("tmp/"), k.cast("string"), F.when(k % 3 == 0, ".part").otherwise(".gguf")).alias("path"), (k * 10).alias("length"))
    wanted = table(spark, d, "orders").select(k.cast("string").alias("upload_id"), (k * 10 + k % 2).alias("total_size"))
    return uploads.size_matches(files, wanted)


@query("SELECT n_nationkey, round(CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey * 1000000.0::DOUBLE / 1048576 / (n_nationkey % 4) END, 6) AS speed, greatest(0, least(10, n_nationkey - 5)) AS held FROM nation")
def speeds_and_clamps(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", F.round(rules.upload_speed(k * 1000000.0, k % 4), 6).alias("speed"), vectors.clamp(k - 5, 0, 10).alias("held"))


STAGES = ("extracting", "chunking", "embedding", "persisting", "complete", "failed")


@query("""WITH e AS (SELECT user_id, ts, event_id, CAST(event_id % 6 AS INTEGER) AS stage, CAST(event_id % 11 AS INTEGER) AS done FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id AS task_id, CASE stage WHEN 0 THEN 10.0 WHEN 1 THEN 20.0 WHEN 2 THEN 20 + done / 10.0::DOUBLE * 50 WHEN 3 THEN 70 + done / 10.0::DOUBLE * 25 WHEN 4 THEN 100.0 ELSE 0.0 END AS progress FROM e""")
def task_progress(spark, d):
    n = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.struct("ts", "event_id").alias("at"), F.get(F.array(*(F.lit(x) for x in STAGES)), (n % 6).cast("int")).alias("stage"), (n % 11).cast("int").alias("embedded"), (n % 11).cast("int").alias("persisted"), F.lit(10).alias("chunks"))
    return uploads.latest_progress(rows).select("task_id", "progress")


# --- search services, providers, settings ----------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT page_id, page_id // 10 AS query_id, page_id % 10 AS position, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, url FROM pages)
SELECT query_id, CAST(position AS INTEGER) AS position, title, url, CASE WHEN page_id % 4 = 0 THEN 'No description available.' ELSE 'about ' || page_id END AS snippet, round(CASE WHEN page_id % 3 = 0 THEN least(1.0, page_id % 13 / 10.0::DOUBLE) ELSE 0.95 - 0.05 * position END, 6) AS score, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS domain FROM p WHERE position < 8""")
def live_search(spark, d):
    """Answers of a search service, as JSON, become results."""
    k = F.col("page_id")
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    item = F.struct(title.alias("title"), "url", F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("about "), k.cast("string"))).alias("content"), F.when(k % 3 == 0, (k % 13) / 10.0).alias("score"))
    answers = table(spark, d, "pages").groupBy(F.floor(k / 10).cast("long").alias("query_id")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("page_id", item.alias("i")))), lambda x: x["i"]).alias("results"))).alias("json"))
    return api.search_responses(answers, 8).drop("published_date")


@query("SELECT item_id, 'http://host/search?q=' || url_encode(text) || '&format=json&pageno=1' AS url FROM benchmark")
def search_urls(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.search_url(F.lit("http://host//"), F.col("text")).alias("url"))


@query("SELECT item_id AS query_id, CAST(5 AS BIGINT) AS n FROM benchmark WHERE trim(text) <> ''")
def search_by_name(spark, d):
    """An unknown provider's name gives the fallback."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return SEARCHES.get("unknown")(asked).groupBy("query_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 OR trim(text) = '' THEN NULL ELSE 8 END AS dimension, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS summary FROM documents")
def embedded_texts(spark, d):
    brain = Brain(dimension=8)
    brain.check(spark)
    body = F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(brain.embed(body)).alias("dimension"), text.shorten(F.col("text"), 40).alias("summary"))


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 768 WHEN 3 THEN 512 WHEN 4 THEN 0 ELSE 384 END AS dimension, n_nationkey % 5 >= 3 AS images FROM nation""")
def embedding_models(spark, d):
    names = F.array(*(F.lit(x) for x in (*vectors.EMBEDDING_MODELS, "own")))
    name = F.get(names, (F.col("n_nationkey") % 5).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", vectors.model_dimension(name).alias("dimension"), vectors.takes_images(name).alias("images"))


@query("""SELECT n_nationkey, kinds[n_nationkey % 8 + 1] AS name, codes[n_nationkey % 8 + 1] AS code, statuses[n_nationkey % 8 + 1] AS status, n_name AS message FROM nation, (SELECT ['Conflict', 'EngineError', 'InvalidRequest', 'NotFound', 'ProviderFailed', 'StoreFailed', 'TooLarge', 'Unavailable'] AS kinds, [409, 500, 400, 404, 502, 500, 413, 503] AS statuses,
['conflict', 'internal_error', 'invalid_request', 'not_found', 'provider_error', 'database_error', 'payload_too_large', 'unavailable'] AS codes)""")
def error_codes(spark, d):
    """Errors of each kind raised in tasks, as a caller gets them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (Conflict, EngineError, InvalidRequest, NotFound, ProviderFailed, StoreFailed, TooLarge, Unavailable)
        for batch in batches:
            rows = []
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    raise kinds[key % 8](name)
                except EngineError as e:
                    rows.append((key, type(e).__name__, e.body()["error"], e.status, e.body()["message"]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (batch.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], ["n_nationkey", "name", "code", "status", "message"])

    rows = table(spark, d, "nation").select("n_nationkey", "n_name")
    return rows.mapInArrow(run, f"n_nationkey {dict(rows.dtypes)['n_nationkey']}, name string, code string, status int, message string")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 1000 ELSE c_custkey END AS capacity, CASE WHEN c_custkey % 3 = 0 THEN 0.5 ELSE 0.7 END AS temperature, c_custkey % 2 = 1 AS normalize, 'knowledge' AS database, '/data/' || c_custkey AS url FROM customer""")
def settings_from_env(spark, d):
    """Settings as each customer's environment has them, some left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in batch.column(0).to_pylist():
                env = {"EMBEDDING_NORMALIZE": ("no", "yes")[k % 2], "STORE_URL": f"/data/{k}"} | ({"CACHE_CAPACITY": str(k)} if k % 4 else {}) | ({} if k % 3 else {"CHAT_TEMPERATURE": "0.5"})
                store = StoreSettings.from_env(env)
                rows.append((k, CacheSettings.from_env(env).capacity, ChatSettings.from_env(env).temperature, EmbeddingSettings.from_env(env).normalize, store.database, store.url))
            kinds = (batch.schema.field(0).type, pa.int64(), pa.float64(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["c_custkey", "capacity", "temperature", "normalize", "database", "url"])

    rows = table(spark, d, "customer").select("c_custkey")
    return rows.mapInArrow(run, f"c_custkey {dict(rows.dtypes)['c_custkey']}, capacity long, temperature double, normalize boolean, database string, url string")


@query(f"WITH {NODES} SELECT 'graphloom/knowledge' AS place, true AS healthy, true AS refused, namespace, count(*) AS nodes FROM nodes GROUP BY namespace")
def store_connect(spark, d):
    """A store by its settings, and one whose folder can't be."""
    base = scratch(spark)
    store = Repository.connect(spark, StoreSettings(url=base))
    spark.range(1).coalesce(1).write.parquet(f"{base}/file")
    file = next(r.path for r in uploads.listing(spark, f"{base}/file").collect() if r.path.endswith(".parquet"))
    refused = False
    try:
        Repository.connect(spark, StoreSettings(url=file))
    except StoreFailed:
        refused = True
    store.append("nodes", _node_rows(spark, d))
    found = Repository.connect(spark, StoreSettings(url=base)).read("nodes")
    return found.groupBy("namespace").agg(F.count("*").alias("nodes")).withColumns({"place": F.lit(store.base.removeprefix(f"{base}/")), "healthy": F.lit(store.healthy()), "refused": F.lit(refused)})


@query("SELECT n_nationkey, n_nationkey * 10 > 0 AND n_nationkey % 7 * 30 < n_nationkey * 10 AND n_nationkey % 3 * 50 <= n_nationkey * 10 AS good FROM nation")
def settings_checked(spark, d):
    """Which settings, as environment variables, are accepted."""

    def good(k: int) -> bool:
        try:
            IngestionSettings.from_env({"INGESTION_CHUNK_SIZE": str(10 * k), "INGESTION_CHUNK_OVERLAP": str(k % 7 * 30), "INGESTION_MIN_CHUNK_SIZE": str(k % 3 * 50)})
        except InvalidRequest:
            return False
        return True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([good(k) for k in batch.column(0).to_pylist()])], ["n_nationkey", "good"])

    rows = table(spark, d, "nation").select("n_nationkey")
    return rows.mapInArrow(run, f"n_nationkey {dict(rows.dtypes)['n_nationkey']}, good boolean")


# --- schedules -------------------------------------------------------------------------------------------------------------------------


def _scan(window: str, seconds: int) -> str:
    return f"""WITH RECURSIVE t AS (SELECT DISTINCT event_type AS namespace, epoch_us(ts) AS us FROM events WHERE {window}), o AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY us) AS k FROM t),
s AS (SELECT namespace, k, us, us AS last, true AS starts FROM o WHERE k = 1 UNION ALL SELECT o.namespace, o.k, o.us, CASE WHEN o.us - s.last >= {seconds * 1000000} THEN o.us ELSE s.last END, o.us - s.last >= {seconds * 1000000} FROM s JOIN o ON o.namespace = s.namespace AND o.k = s.k + 1)
SELECT namespace, us AS at FROM s WHERE starts"""


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("namespace"), F.col("ts").cast("timestamp").alias("at"))


@query(_scan("true", 3 * 3600))
def interval_runs(spark, d):
    return schedule.interval_runs(_ticks(spark, d), 3 * 3600).select("namespace", F.unix_micros("at").alias("at"))


@query(_scan("hour(ts) >= 22 OR hour(ts) < 5", 20 * 3600))
def nightly_runs(spark, d):
    return schedule.nightly_runs(_ticks(spark, d), 22, 5, 20).select("namespace", F.unix_micros("at").alias("at"))


@query(f"WITH {NODES}, i AS (SELECT * FROM nodes WHERE status = 'incomplete' ORDER BY node_id LIMIT 30) SELECT CAST(count(*) AS BIGINT) AS nodes_processed, CAST(least(count(*), 4) AS BIGINT) AS nodes_synthesized, CAST(5 * least(count(*), 4) AS BIGINT) AS sources FROM i")
def rem_run(spark, d):
    rows = tables.nodes(spark, d).filter("status = 'incomplete'").select("node_id", "content")
    return api.run_once(rows, RemSettings(max_nodes=30, batch_size=4))[1]


# --- graphs, clusters, texts -----------------------------------------------------------------------------------------------------------


@query(f"WITH {EDGES} SELECT src, dst, similarity FROM edges WHERE CAST(src AS BIGINT) % 3 <> 0")
def known_edges(spark, d):
    nodes = tables.nodes(spark, d).filter("doc_id % 3 != 0").select(F.col("node_id").alias("node"))
    return paths.known_edges(_edges(spark, d), nodes).select("src", "dst", "similarity")


@query(f"WITH {NODES} SELECT a.node_id AS a, b.node_id AS b, CASE WHEN a.node_id = b.node_id THEN 1.0 ELSE round(list_cosine_similarity(a.v, b.v), 6) END AS similarity FROM nodes a JOIN nodes b ON a.namespace = b.namespace WHERE a.namespace = 'user_fr'")
def similarity_matrix(spark, d):
    return search.similarity_matrix(tables.nodes(spark, d).filter("namespace = 'user_fr'"), "namespace").select("a", "b", "similarity")


@query("""SELECT c_custkey, CASE WHEN k = m THEN k || ',' || m2 ELSE k || ',' || m || CASE WHEN m2 IN (k, m) THEN '' ELSE ',' || m2 END END AS merged, list_contains([k, m], 2) AS has_two FROM (SELECT c_custkey, c_nationkey AS k, c_custkey % 5 AS m, c_custkey % 3 AS m2 FROM customer) WHERE k <> m OR m2 <> k""")
def cluster_members(spark, d):
    k = F.col("c_custkey")
    members = rules.add_member(F.array(F.col("c_nationkey").cast("long")), k % 5)
    rows = table(spark, d, "customer").filter((F.col("c_nationkey") != k % 5) | (k % 3 != F.col("c_nationkey")))
    return rows.select("c_custkey", F.array_join(rules.add_member(members, k % 3), ",").alias("merged"), F.array_contains(members, F.lit(2).cast("long")).alias("has_two"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '1,2,3' WHEN 1 THEN '0,2,3' WHEN 2 THEN '0,1,3' ELSE '0,1,2' END AS rest, CASE WHEN c_custkey % 4 = 3 THEN '0;1,2' ELSE CASE WHEN c_custkey % 4 = 0 THEN '1,2' ELSE '0;' || CASE WHEN c_custkey % 4 = 1 THEN '2' ELSE '1' END END END AS parts FROM customer")
def cluster_parts(spark, d):
    """A member removed, then a partition of which empty parts go."""
    rest = rules.remove_member(F.array(*(F.lit(x).cast("long") for x in range(4))), F.col("c_custkey") % 4)
    parts = rules.split_members(rest, F.array(F.array(F.lit(0).cast("long")), F.array(F.lit(1).cast("long"), F.lit(2).cast("long")), F.array(F.lit(9).cast("long"))))
    return table(spark, d, "customer").select("c_custkey", F.array_join(rest, ",").alias("rest"), F.array_join(F.transform(parts, lambda p: F.array_join(p, ",")), ";").alias("parts"))


_SHORT = "|".join(x.replace(".", r"\.") for x in sorted(chunk.ABBREVIATIONS, key=len, reverse=True))
#: A sentence's end becomes chr(1) and the white space behind it; ends that don't count become chr(2) first.
SENTENCES = rf"""sentences AS (SELECT r, doc_id, k, s, strlen(s) AS n FROM (SELECT r, doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS s FROM (
  SELECT r, doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '((?:{_SHORT})\.?)([{oracles.SPACES}]|$)', '\1' || chr(2) || '\2', 'g'), '(^|[{oracles.SPACES}])(\p{{Lu}}\.)([{oracles.SPACES}]|$)', '\1\2' || chr(2) || '\3', 'g'), '(^|[{oracles.SPACES}])(\p{{Lu}}\.)([{oracles.SPACES}]|$)', '\1\2' || chr(2) || '\3', 'g'),
    '([.!?])([{oracles.SPACES}]|$)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {oracles.stripped("replace(x, chr(2), '')")}), lambda x: x <> '') AS l FROM trimmed)))"""
TRIMMED = f"trimmed AS (SELECT row_number() OVER () AS r, doc_id, {oracles.stripped("coalesce(text, '')")} AS t FROM documents)"


@query(f"""WITH RECURSIVE {TRIMMED}, {SENTENCES},
pack AS (SELECT r, 0::BIGINT AS k, '' AS held, 0::BIGINT AS length, 0::BIGINT AS start, CAST(NULL AS VARCHAR) AS content, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM (SELECT DISTINCT r FROM sentences)
  UNION ALL SELECT r, k, CASE WHEN cut OR held = '' THEN s ELSE held || ' ' || s END, CASE WHEN cut THEN n WHEN held = '' THEN length + n ELSE length + n + 1 END, CASE WHEN cut THEN greatest(0, start + length - 200) ELSE start END, CASE WHEN cut THEN held END, CASE WHEN cut THEN start END, CASE WHEN cut THEN start + length END
  FROM (SELECT p.r, q.k, p.held, p.length, p.start, q.s, q.n, p.held <> '' AND p.length + q.n + 1 > 1000 AS cut FROM pack p JOIN sentences q ON q.r = p.r AND q.k = p.k + 1)),
found AS (SELECT r, k, content, a, b FROM pack WHERE content IS NOT NULL UNION ALL SELECT r, k + 1, held, start, start + length FROM (SELECT * FROM pack QUALIFY row_number() OVER (PARTITION BY r ORDER BY k DESC) = 1) WHERE held <> '' AND length >= 100)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY found.r ORDER BY k) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY found.r) AS INTEGER) AS total, content, CAST(a AS INTEGER) AS start_offset, CAST(b AS INTEGER) AS end_offset FROM found JOIN trimmed USING (r)""")
def chunk_sentences(spark, d):
    return chunk.chunked(table(spark, d, "documents"), by_sentence=True)


@query("SELECT doc_id, CAST(to_json({'lang': lang, 'source': source, 'n_chars': n_chars, 'tags': [lang, source]}) AS VARCHAR) AS metadata, lang, n_chars, source AS last_tag, doc_id % 7 = 0 AS broken FROM documents")
def metadata_json(spark, d):
    """Metadata as JSON, and read back from it; JSON that was cut off reads as nothing."""
    metadata = F.to_json(F.struct("lang", "source", "n_chars", F.array("lang", "source").alias("tags")))
    rows = table(spark, d, "documents").select("doc_id", metadata.alias("metadata"))
    kind = "struct<lang:string,source:string,n_chars:long,tags:array<string>>"
    cut = F.when(F.col("doc_id") % 7 == 0, F.substring("metadata", 1, 9)).otherwise(F.col("metadata"))
    back = rows.select("doc_id", "metadata", F.from_json("metadata", kind).alias("m"), F.from_json(cut, kind)["n_chars"].isNull().alias("broken"))
    return back.select("doc_id", "metadata", "m.lang", "m.n_chars", F.element_at("m.tags", -1).alias("last_tag"), "broken")
