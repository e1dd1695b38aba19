"""The knowledge model's tables: their schemas, and views of the star-schema tables in their shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graphloom.functions.rules import GLOBAL

EMBEDDING = "struct<vector:array<float>,model:string,dimension:int>"
METADATA = "struct<source:string,source_type:string,source_url:string,author:string,tags:array<string>,language:string,access_count:bigint>"
DDL = {
    "nodes": f"node_id string, uuid string, node_type string, status string, content string, summary string, embedding {EMBEDDING}, depth_level int, confidence float, namespace string, scope string, metadata {METADATA}, created_at timestamp, updated_at timestamp, last_accessed_at timestamp",
    "edges": "src string, dst string, edge_type string, weight float, similarity float, confidence float, created_at timestamp, updated_at timestamp",
    "namespaces": "name string, namespace_type string, description string, created_at timestamp",
    "scopes": "user_id string, namespace string, permissions struct<read:boolean,write:boolean,delete:boolean,access_global:boolean>, created_at timestamp, expires_at timestamp",
    "models": "id string, name string, architecture struct<model_type:string,n_layers:int,embedding_dim:int,vocab_size:int,n_heads:int,ffn_dim:int>, root_node_id string, status string, file_path string, file_size bigint, conversion_progress float, conversion_phase string, created_at timestamp, updated_at timestamp, metadata string",
    "model_nodes": "id string, model_id string, embedding array<float>, layer_info struct<layer_start:int,layer_end:int,layer_type:string,summary:string,metadata:string>, parent_id string, children_ids array<string>, level int",
    "upload_sessions": "upload_id string, filename string, total_size bigint, chunk_size bigint, total_chunks bigint, chunks_received array<bigint>, status string, temp_path string, model_id string, upload_progress float, conversion_progress float, current_phase string, upload_speed_mbps float, last_chunk_at timestamp, created_at timestamp, updated_at timestamp",
}


def schema(name: str) -> T.StructType:
    """A table's schema; needs a running session."""
    return T.StructType.fromDDL(DDL[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an embedding, as leaves: English ones are global, others their language's."""
    docs, vectors, labels = (table(spark, sf_dir, x) for x in ("documents", "embeddings", "labels"))
    status = F.when(F.col("toxic") == 1, "deprecated").when(F.col("quality") == 0, "incomplete").when(F.col("quality").isNull(), "pending").otherwise("complete")
    return (
        docs.join(vectors, docs["doc_id"] == vectors["vec_id"])
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").cast("string").alias("node_id"), "doc_id", F.col("text").alias("content"), F.col("embedding").alias("vector"),
            F.when(F.col("lang") == "en", GLOBAL).otherwise(F.concat(F.lit("user_"), "lang")).alias("namespace"), status.alias("status"),
            F.lit("leaf").alias("node_type"), F.lit(0).alias("depth_level"), F.lit(1.0).alias("confidence"), "source", F.col("lang").alias("language"), F.array("source", "lang").alias("tags"),
        )
    )


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often and when each node was used, from events by user."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed_at"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as nodes of their own namespace."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.concat_ws("_", F.lit("turn"), "conv_id", "turn").alias("node_id"), "conv_id", "turn", "role", F.col("text").alias("content"), F.concat(F.lit("user_"), F.col("conv_id").cast("string")).alias("namespace"), F.lit("conversation").alias("source_type"))


def temporal_edges(turns: DataFrame) -> DataFrame:
    """From each turn to the next one of its conversation."""
    after = F.lead("node_id").over(Window.partitionBy("conv_id").orderBy("turn", "node_id"))
    return turns.select(F.col("node_id").alias("src"), after.alias("dst"), F.lit("temporal").alias("edge_type")).filter("dst is not null")


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as web search results, ten to a query, with scores by position where none is given."""
    pages = table(spark, sf_dir, "pages")
    position = (F.col("page_id") % 10).cast("int")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.95 - 0.05 * position))
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return pages.select("page_id", F.floor(F.col("page_id") / 10).cast("long").alias("query_id"), position.alias("position"), "url", title.alias("title"), F.round(score, 6).alias("score"), F.try_parse_url("url", F.lit("HOST")).alias("domain"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as upload sessions of seven chunks."""
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "uploading").otherwise("converting")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("upload_id"), F.lit(7).cast("long").alias("total_chunks"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("size"))


def chunk_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as arriving chunks; some arrive more than once."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("upload_id"), (F.col("l_linenumber") - 1).cast("long").alias("chunk"), F.col("l_shipdate").alias("at"), F.col("l_extendedprice").alias("bytes"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as converted models."""
    key = F.col("r_regionkey")
    status = F.when(key % 3 == 0, "ready").when(key % 3 == 1, "converting").otherwise("failed")
    return table(spark, sf_dir, "region").select(F.concat(F.lit("fractal_models:"), key.cast("string")).alias("id"), F.col("r_name").alias("name"), status.alias("status"), F.concat(F.lit("r"), key.cast("string")).alias("root_node_id"), F.expr("timestamp'2024-01-01' + make_dt_interval(r_regionkey * 7 % 5)").alias("created_at"), ((key + 1) * 1500000007).cast("long").alias("parameters"))


def model_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as the levels of the models' trees; suppliers have vectors."""
    region, nation, supplier, vectors = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier", "embeddings"))
    tag = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    none, model = F.lit(None), tag("fractal_models:", "r_regionkey").alias("model_id")
    roots = region.select(tag("r", "r_regionkey").alias("id"), model, none.cast("string").alias("parent_id"), F.lit(2).alias("level"), none.cast("array<float>").alias("vector"))
    middle = nation.select(tag("n", "n_nationkey").alias("id"), tag("fractal_models:", "n_regionkey").alias("model_id"), tag("r", "n_regionkey").alias("parent_id"), F.lit(1).alias("level"), none.cast("array<float>").alias("vector"))
    placed = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(vectors, F.col("s_suppkey") == F.col("vec_id"), "left")
    leaves = placed.select(tag("s", "s_suppkey").alias("id"), tag("fractal_models:", "n_regionkey").alias("model_id"), tag("n", "n_nationkey").alias("parent_id"), F.lit(0).alias("level"), F.col("embedding").alias("vector"))
    return roots.unionByName(middle).unionByName(leaves)
