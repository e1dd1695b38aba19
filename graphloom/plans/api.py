"""What a user of the engine calls: search, ask, ingest, remember, update, build and consolidate, each a plan over the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.common import written
from graphloom.config import IngestionSettings, RemSettings
from graphloom.functions import text as t
from graphloom.functions.rules import GLOBAL, edge_weight, health, is_pdf
from graphloom.functions.vectors import cosine, mock_embedding
from graphloom.operators.chunk import chunked
from graphloom.operators.cluster import ClusterConfig, hierarchy, sibling_edges, tree_nodes, tree_stats
from graphloom.operators.paths import fused_rank
from graphloom.operators.search import similar_across, top_k_each
from graphloom.sources.repository import Repository

#: Defaults of search and ask, and the answers without a chat model.
SEARCH_LIMIT, SEARCH_LEAST, ASK_LIMIT, ASK_LEAST = 10, 0.5, 5, 0.4
NOTHING_FOUND = "No relevant information found in the knowledge base."
#: Sites of the mock search provider.
MOCK_SITES = (("Wikipedia", "https://en.wikipedia.org"), ("Stack Overflow", "https://stackoverflow.com"), ("GitHub", "https://github.com"), ("Documentation", "https://docs.rs"), ("Blog Post", "https://medium.com"))
#: What a mock result says before and behind the query, and the parts of a synthesized text before the question, the sources and what they say.
MOCK_SNIPPET = ("This is a mock search result for '", "'. It contains relevant information about the topic and provides context for the REM phase synthesis.")
SYNTHESIS = ("# Synthesized Knowledge\n\n**Original Query:** ", "\n\n**Sources:**\n", "\n\n**Combined Information:**\n")

Embedder = Callable[[Column], Column]


def default_embedder(dimension: int = 64) -> Embedder:
    return lambda text: mock_embedding(text, dimension)


def search(nodes: DataFrame, edges: DataFrame, queries: DataFrame, limit: int = SEARCH_LIMIT, least: float = SEARCH_LEAST, by_namespace: bool = True, alike: float | None = None) -> DataFrame:
    """Ranked nodes of each query (query_id, vector, namespace): twice the limit of nearest nodes at or above `least`, fused with the graph. Where a namespace has no edges, ranks follow similarity.
    alike: leaves of a namespace that are so similar are linked both ways, besides the edges; only pairs of a query's own hits are compared for that, as no others are of use."""
    hits = top_k_each(nodes, queries, 2 * limit, "node_id", "vector", "query_id", "namespace" if by_namespace else None).filter(F.col("similarity") >= least)
    hits = written(hits.join(nodes.select("node_id", "node_type"), "node_id").select("query_id", "node_id", "similarity", "node_type"))
    more = None
    if alike is not None:
        own = written(hits.filter("node_type = 'leaf'").select("query_id", "node_id").join(nodes.select("node_id", "namespace", "vector"), "node_id"))
        a, b = own.withColumnsRenamed({"node_id": "src", "vector": "x"}), own.withColumnsRenamed({"node_id": "dst", "vector": "y"})
        pairs = a.join(b, ["query_id", "namespace"]).filter("src < dst").select("query_id", "src", "dst", F.round(cosine(F.col("x"), F.col("y")), 6).alias("similarity")).filter(F.col("similarity") >= alike)
        more = pairs.unionByName(pairs.withColumns({"src": F.col("dst"), "dst": F.col("src")}))
    ranked = fused_rank(hits, edges, edges.filter("edge_type = 'parentchild'"), limit, more=more)
    return ranked.join(nodes.select("node_id", "namespace", "node_type", "content", "source", "depth_level"), "node_id")


def ask(nodes: DataFrame, questions: DataFrame, limit: int = ASK_LIMIT, least: float = ASK_LEAST, by_namespace: bool = True, chat: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """query_id, n_sources, context and answer of each question. At most `limit` of twice as many nearest nodes are sources. chat makes the answer of a question (the column `question`, then needed) and its
    context, where it has sources; without, the answer is the context, and where chat gives null as well."""
    hits = top_k_each(nodes, questions, 2 * limit, "node_id", "vector", "query_id", "namespace" if by_namespace else None).filter((F.col("similarity") >= least) & (F.col("rank") <= limit))
    told = hits.join(nodes.select("node_id", "content", "source"), "node_id")
    line = t.source_line(F.col("rank"), F.col("source"), F.col("similarity"), F.col("content"))
    context = told.groupBy("query_id").agg(F.count("*").alias("n_sources"), t.ordered_text(F.col("rank"), line, t.SOURCE_BREAK).alias("context"))
    asked = questions.select("query_id", *["question"] * (chat is not None))
    out = asked.join(context, "query_id", "left").withColumns({"n_sources": F.coalesce("n_sources", F.lit(0)).cast("long"), "context": F.coalesce("context", F.lit(""))})
    found = F.concat(F.lit("Found "), F.col("n_sources").cast("string"), F.lit(" relevant sources:\n\n"), F.col("context"))
    found = found if chat is None else F.coalesce(chat(F.col("question"), F.col("context")), found)
    return out.withColumn("answer", F.when(F.col("n_sources") == 0, NOTHING_FOUND).otherwise(found)).select("query_id", "n_sources", "context", "answer")


def node_key(*parts: Column | str) -> Column:
    """A node's id follows from its contents, so that ingesting again gives the same node."""
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 32)


def ingest_documents(docs: DataFrame, embedder: Embedder | None = None, namespace: str = GLOBAL, chunk: bool = True, size: int = 1000, overlap: int = 200, least: int = 100) -> DataFrame:
    """Leaf nodes of documents (doc_id, text, source), one for each chunk; blank ones are left out, equal contents of a namespace are one node."""
    full = docs.filter(F.trim("text") != "")
    if chunk:  # id and source go through together: joined back by id, rows that share one would multiply
        both = full.select(F.struct("doc_id", "source").alias("row"), "text")
        parts = chunked(both, "row", "text", size, overlap, least).select("row.doc_id", "row.source", "chunk_index", "total", "content", "start_offset", "end_offset")
    else:
        parts = full.select("doc_id", F.lit(0).alias("chunk_index"), F.lit(1).alias("total"), F.col("text").alias("content"), F.lit(0).alias("start_offset"), F.octet_length("text").alias("end_offset"), "source")
    tag = F.concat(F.lit("chunk:"), (F.col("chunk_index") + 1).cast("string"), F.lit("/"), F.col("total").cast("string"))
    rows = parts.groupBy("content").agg(F.min(F.struct("doc_id", "chunk_index", "total", "source")).alias("p")).select("content", "p.*")
    out = rows.select(node_key(F.lit(namespace).alias("n"), F.col("content").alias("c")).alias("node_id"), "doc_id", "content", F.lit(namespace).alias("namespace"), F.lit("leaf").alias("node_type"), F.lit("complete").alias("status"), F.lit(0).alias("depth_level"), F.lit(1.0).alias("confidence"), "source", F.array(tag).alias("tags"))
    return out.withColumn("vector", (embedder or default_embedder())(F.col("content")))


def file_tags(tags: Column) -> Column:
    """Tags as a form sends them: a JSON array of texts, or one tag."""
    return F.when(F.trim(tags) == "", F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(tags, "array<string>"), F.array(tags)))


def file_gates(files: DataFrame, settings: IngestionSettings = IngestionSettings()) -> DataFrame:
    """files (path, length) with `refused`: why a file isn't taken, null if it is."""
    extension = F.lower(F.regexp_extract("path", r"[.]([^./]+)$", 1))
    allowed = [x.strip() for x in settings.allowed.split(",")]
    return files.withColumn("refused", F.when(F.col("length") < 1, "empty").when(F.col("length") > settings.max_file_size, "too large").when(~extension.isin(*allowed), "type not allowed"))


def ingest_files(files: DataFrame, embedder: Embedder | None = None, namespace: str = GLOBAL, settings: IngestionSettings = IngestionSettings(), decoders: dict[str, Callable[[Column], Column]] | None = None, **chunking) -> tuple[DataFrame, DataFrame]:
    """Nodes of a binaryFile source, and a report: path, file_type, warning. Files that the settings refuse (see file_gates) have only a warning. Text is decoded here; PDF and images by `decoders`
    where given, else they get a warning and no nodes. A PDF decoder gets only what begins as a PDF. Of columns that a form adds, tags (see file_tags) go before the chunk's own tag, and language
    is kept."""
    gated = file_gates(files, settings).withColumn("file_type", t.file_type(F.col("path")))
    typed = gated.filter("refused is null").filter((F.col("file_type") != "pdf") | is_pdf(F.col("content")) | F.lit("pdf" not in (decoders or {})))
    text = typed.filter("file_type = 'text'").withColumn("d", t.decode_bytes(F.col("content"))).select("path", "file_type", t.squeeze(t.unix_lines(F.col("d.text"))).alias("text"), F.when(F.col("d.lossy"), "some characters could not be decoded").alias("warning"))
    for kind, decode in (decoders or {}).items():
        own = typed.filter(F.col("file_type") == kind).select("path", "file_type", t.clean_extracted(decode(F.col("content")), kind == "image").alias("text"), F.lit(None).cast("string").alias("warning"))
        text = text.unionByName(own)
    left = typed.filter(~F.col("file_type").isin("text", *(decoders or {}))).select("path", "file_type", F.lit("no decoder for this type").alias("warning"))
    report = text.select("path", "file_type", "warning").unionByName(left).unionByName(gated.filter("refused is not null").select("path", "file_type", F.col("refused").alias("warning")))
    nodes = ingest_documents(text.select(F.col("path").alias("doc_id"), "text", F.col("path").alias("source")), embedder, namespace, **chunking)
    asked = [c for c in ("tags", "language") if c in files.columns]
    if asked:
        own = files.select(F.col("path").alias("doc_id"), *(F.col(c).alias(f"_{c}") for c in asked))
        nodes = nodes.join(own, "doc_id", "left")
        if "tags" in asked:
            nodes = nodes.withColumn("tags", F.concat(F.coalesce(file_tags(F.col("_tags")), F.array().cast("array<string>")), "tags"))
        if "language" in asked:
            nodes = nodes.withColumn("language", F.col("_language"))
        nodes = nodes.drop(*(f"_{c}" for c in asked))
    return nodes, report


def remember(turns: DataFrame, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversation turns (node_id, conv_id, turn, content, namespace) as nodes, and the edges from each turn to the next."""
    from graphloom.sources.tables import temporal_edges

    full = turns.filter(F.trim("content") != "")
    nodes = full.select("node_id", "conv_id", "turn", "content", "namespace", F.lit("leaf").alias("node_type"), F.lit("complete").alias("status"), F.lit("conversation").alias("source_type"), F.lit(0).alias("depth_level"), F.lit(1.0).alias("confidence"))
    return nodes.withColumn("vector", (embedder or default_embedder())(F.col("content"))), temporal_edges(full)


def update_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """nodes with the non-null of content, status, tags and deprecated of changes (node_id unique), and updated_fields, the names of what changed."""
    c = changes.select("node_id", *(F.col(x).alias(f"_{x}") for x in ("content", "status", "tags", "deprecated")))
    joined = nodes.join(c, "node_id", "left")
    status = F.when(F.coalesce("_deprecated", F.lit(False)), "deprecated").otherwise(F.coalesce("_status", "status"))
    fields = F.filter(F.array(*(F.when(F.col(f"_{x}").isNotNull(), x) for x in ("content", "status", "tags", "deprecated"))), lambda x: x.isNotNull())
    return joined.withColumns({"updated_fields": fields, "content": F.coalesce("_content", "content"), "status": status, "tags": F.coalesce("_tags", "tags")}).drop("_content", "_status", "_tags", "_deprecated")


def build_hierarchy(nodes: DataFrame, config: ClusterConfig = ClusterConfig(), least_nodes: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parent nodes, edges and statistics of the leaves of every namespace with enough of them. Built again, they are the same rows."""
    leaves = nodes.filter("node_type = 'leaf' and depth_level = 0")
    enough = leaves.groupBy("namespace").agg(F.count("*").alias("n")).filter(F.col("n") >= least_nodes)
    tree = written(hierarchy(leaves.join(enough.select("namespace"), "namespace", "left_semi"), config))
    parents, down = tree_nodes(tree)
    across = sibling_edges(tree, config.threshold).select("src", "dst", F.lit(None).cast("string").alias("namespace"), "edge_type", "similarity", "weight", F.lit(0.8).alias("confidence"))
    return parents, down.unionByName(across), tree_stats(tree)


def mock_search(queries: DataFrame, most: int = 5) -> DataFrame:
    """query_id, position, title, url, snippet, score and domain of the mock provider for each query (query_id, query); blank queries find nothing."""
    sites = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(u).alias("base")) for n, u in MOCK_SITES[:most]))
    rows = queries.filter(F.trim("query") != "").select("query_id", "query", F.posexplode(sites).alias("position", "s"))
    snippet = F.concat(F.lit(MOCK_SNIPPET[0]), F.col("query"), F.lit(MOCK_SNIPPET[1]))
    return rows.select("query_id", "position", F.concat("s.name", F.lit(" - "), "query").alias("title"), F.concat("s.base", F.lit("/search?q="), F.replace("query", F.lit(" "), F.lit("+"))).alias("url"), snippet.alias("snippet"), F.round(0.9 - 0.1 * F.col("position"), 6).alias("score"), F.replace("s.base", F.lit("https://"), F.lit("")).alias("domain"))


def search_responses(responses: DataFrame, most: int = 10) -> DataFrame:
    """Results of a search service's answers (query_id, json): at most so many each, in their order: position, title, url, snippet, score, domain and published_date.

    A score that isn't given falls with the position from 0.95 by 0.05; scores are held to 0 ... 1. An empty snippet is replaced. An answer that is no JSON has no results."""
    item = "struct<title:string,url:string,content:string,score:double,publishedDate:string>"
    results = F.slice(F.from_json("json", f"struct<results:array<{item}>>")["results"], 1, most)
    rows = responses.select("query_id", F.posexplode(results).alias("position", "r"))
    score = F.coalesce("r.score", 0.95 - 0.05 * F.col("position"))
    return rows.select(
        "query_id", "position", "r.title", "r.url", F.when(F.coalesce("r.content", F.lit("")) == "", t.NO_SNIPPET).otherwise(F.col("r.content")).alias("snippet"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"), t.domain(F.col("r.url")).alias("domain"), F.col("r.publishedDate").alias("published_date")
    )


def synthesize(incomplete: DataFrame, provider: Callable[[DataFrame], DataFrame] = mock_search) -> DataFrame:
    """A global leaf for each incomplete node (node_id, content) that a search finds something for: the question, its sources and what they say."""
    asked = incomplete.select(F.col("node_id").alias("query_id"), "content", t.search_query(F.col("content")).alias("query"))
    found = provider(asked.select("query_id", "query"))
    line = t.snippet_line(F.col("title"), F.col("url"), F.col("snippet"))
    said = found.groupBy("query_id").agg(t.ordered_text(F.col("position"), F.concat(F.lit("- "), F.col("url")), "\n").alias("sources"), t.ordered_text(F.col("position"), line, t.PART_BREAK).alias("snippets"), F.count("*").alias("n_sources"))
    text = F.concat(F.lit(SYNTHESIS[0]), "content", F.lit(SYNTHESIS[1]), "sources", F.lit(SYNTHESIS[2]), "snippets")
    return asked.join(said, "query_id").select(F.col("query_id").alias("related_to"), text.alias("content"), "n_sources", F.lit(GLOBAL).alias("namespace"), F.lit("synthetic").alias("source_type"))


def cross_links(nodes: DataFrame, least: float = 0.7) -> DataFrame:
    """Edges between similar nodes of different namespaces, with the similarity as confidence."""
    pairs = similar_across(nodes, least)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("crossnamespace").alias("edge_type"), F.round(edge_weight(F.col("similarity")), 6).alias("weight"), "similarity", F.col("similarity").alias("confidence"))


def run_once(incomplete: DataFrame, settings: RemSettings = RemSettings(), provider: Callable[[DataFrame], DataFrame] = mock_search) -> tuple[DataFrame, DataFrame]:
    """One run over incomplete nodes (node_id, content): the max_nodes first by id are taken, and the batch_size first of those are searched for. Synthesized nodes, and one row of counts."""
    taken = written(incomplete.orderBy("node_id").limit(settings.max_nodes))
    new = synthesize(taken.orderBy("node_id").limit(settings.batch_size).select("node_id", "content"), provider)
    counts = taken.agg(F.count("*").alias("nodes_processed")).join(new.agg(F.count("*").alias("nodes_synthesized"), F.coalesce(F.sum("n_sources"), F.lit(0)).cast("long").alias("sources")))  # one row each
    return new, counts


def consolidate(nodes: DataFrame, config: ClusterConfig = ClusterConfig(), most_nodes: int | None = None, link_least: float = 0.7, provider: Callable[[DataFrame], DataFrame] = mock_search) -> dict[str, DataFrame]:
    """Nightly consolidation: answers for incomplete nodes, new hierarchies, links across namespaces, and a row of counts for each namespace. most_nodes: so many leaves of each namespace, the first
    by id, are clustered, and so many incomplete ones asked for; none: all."""
    asked = nodes.filter("status = 'incomplete'")
    if most_nodes is not None:
        first = Window.partitionBy("namespace").orderBy("node_id")  # ids alone are ranked; Spark keeps the first of each partition before it shuffles
        taken = written(nodes.filter("depth_level = 0").select("node_id", "namespace").withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= most_nodes).select("node_id"))
        nodes, asked = nodes.join(taken, "node_id", "left_semi"), asked.orderBy("node_id").limit(most_nodes)
    new = synthesize(asked.select("node_id", "content"), provider)
    parents, edges, stats = build_hierarchy(nodes, config, 3)
    links = cross_links(nodes, link_least)
    leaves = nodes.filter("depth_level = 0").groupBy("namespace").agg(F.count("*").alias("n"))
    count = lambda df, name: df.filter("namespace is not null").groupBy("namespace").agg(F.count("*").alias(name))
    report = leaves.join(count(parents, "parents"), "namespace", "left").join(count(edges, "edges"), "namespace", "left")
    report = report.select("namespace", F.col("n").alias("nodes_processed"), F.coalesce("parents", F.lit(0)).alias("parents_created"), F.coalesce("edges", F.lit(0)).alias("edges_created"))
    return {"synthesized": new, "parents": parents, "edges": edges, "cross_links": links, "stats": stats, "report": report}


def namespace_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges (by their source) of each namespace."""
    n = nodes.groupBy("namespace").agg(F.count("*").alias("node_count"))
    e = edges.join(nodes.select(F.col("node_id").alias("src"), F.col("namespace").alias("ns")), "src").groupBy(F.col("ns").alias("namespace")).agg(F.count("*").alias("edge_count"))
    zero = F.lit(0).cast("long")
    return n.join(e, "namespace", "full").select("namespace", F.coalesce("node_count", zero).alias("node_count"), F.coalesce("edge_count", zero).alias("edge_count"))


def system_health(spark: SparkSession, store: Repository | None = None, has_model: bool = True) -> DataFrame:
    """status and its components; the database is there if the store answers, or, without one, if a job runs."""
    there = store.healthy() if store is not None else spark.range(1).count() == 1
    return spark.range(1).select(health(F.lit(there), F.lit(has_model)).alias("status"), F.lit(there).alias("database"), F.lit(has_model).alias("llm"), F.lit(True).alias("cache"))


def store_hierarchy(store: Repository, nodes: DataFrame, config: ClusterConfig = ClusterConfig(), least_nodes: int = 5) -> DataFrame:
    """Builds the hierarchy and stores its parents and edges; parents that are built again replace themselves, and their edges are those of the new build. Returns the statistics."""
    parents, edges, stats = build_hierarchy(nodes, config, least_nodes)
    parents, edges = written(parents), written(edges)
    now = F.current_timestamp()
    vector = F.struct(F.col("vector").cast("array<float>").alias("vector"), F.lit("mean").alias("model"), F.size("vector").alias("dimension"))
    meta = F.struct(F.col("source"), F.lit("synthetic").alias("source_type"), F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("string").alias("author"), F.col("tags"), F.lit(None).cast("string").alias("language"), F.lit(0).cast("bigint").alias("access_count"))
    store.upsert("nodes", parents.select("node_id", "node_type", "status", "content", vector.alias("embedding"), "depth_level", "confidence", "namespace", meta.alias("metadata"), now.alias("created_at"), now.alias("updated_at")), "node_id")
    ids = written(parents.select("node_id"))
    old = store.read("edges")
    before = old.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").unionByName(old.join(edges.select("src", "dst"), ["src", "dst"], "left_semi")).select("src", "dst").distinct()
    kept = old.join(before, ["src", "dst"], "left_anti").select(*old.columns)
    new = edges.select("src", "dst", "edge_type", "weight", "similarity", "confidence", now.alias("created_at"), now.alias("updated_at"))
    store.replace("edges", kept.unionByName(new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema))))
    return stats


def store_models(store: Repository, folder: str, dimension: int = 768) -> DataFrame:
    """Converts the model files of a folder and stores models and their nodes; a file that is converted again replaces its model. Returns path, status and error."""
    status, nodes = convert_models(store.spark, folder, dimension)
    status, nodes = written(status), written(nodes)
    now = F.current_timestamp()
    shape = F.struct(*(F.col(f"architecture.{c}").cast("string" if c == "model_type" else "int").alias(c) for c in ("model_type", "n_layers", "embedding_dim", "vocab_size", "n_heads", "ffn_dim")))
    roots = nodes.filter("parent_id is null").groupBy("model_id").agg(F.min("id").alias("root_node_id"))
    models = status.join(roots, F.col("path") == F.col("model_id"), "left")
    done = F.when(F.col("status") == "ready", 100.0).otherwise(0.0)
    store.upsert("models", models.select(F.col("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), shape.alias("architecture"), "root_node_id", "status", F.col("path").alias("file_path"), done.alias("conversion_progress"), now.alias("created_at"), now.alias("updated_at")), "id")
    kinds = F.struct(*(F.lit(None).cast("int").alias(c) for c in ("layer_start", "layer_end")), F.col("layer_type"), *(F.lit(None).cast("string").alias(c) for c in ("summary", "metadata")))
    below = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.col("id"))).alias("children_ids"))  # a third of a model's groups at most
    old = store.read("model_nodes")
    kept = old.join(status.select(F.col("path").alias("model_id")), "model_id", "left_anti").select(*old.columns)
    new = nodes.join(below, "id", "left").select("id", "model_id", F.col("vector").cast("array<float>").alias("embedding"), kinds.alias("layer_info"), "parent_id", F.coalesce("children_ids", F.array().cast("array<string>")).alias("children_ids"), "level")
    store.replace("model_nodes", kept.unionByName(new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema))))
    return status.select("path", "status", "error")


def search_stats(searches: DataFrame) -> DataFrame:
    """Searches (ok boolean, results, latency_ms) in one row: performed, successful, their results and their mean latency, whole milliseconds, 0 without any."""
    ok = F.col("ok")
    good = F.count_if(ok)
    latency = F.when(good > 0, F.floor(F.sum(F.when(ok, F.col("latency_ms"))) / good)).otherwise(0)
    return searches.agg(F.count("*").alias("performed"), good.alias("successful"), F.coalesce(F.sum(F.when(ok, F.col("results"))), F.lit(0)).cast("long").alias("total_results"), latency.cast("long").alias("average_latency_ms"))


def convert_models(spark: SparkSession, folder: str, dimension: int = 768, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """The model files of a folder as trees: status of each file, and model nodes: id, model_id, parent_id, level, layer_type, vector and whether it is the root's child.

    A leaf is a group of layers. Clusters join at a similarity of 0.55, of at most a third of the groups or four, four levels high. A file that can't be read is failed, and has no nodes.
    """
    from graphloom.sources.gguf import group_vectors, layer_groups, read_models

    tensors = written(read_models(spark, folder, compat))
    status = tensors.groupBy("path").agg(F.max("error").alias("error"), F.first("architecture", ignorenulls=True).alias("architecture"))
    status = status.select("path", F.when(F.col("error").isNull(), "ready").otherwise("failed").alias("status"), "error", "architecture")
    groups = written(group_vectors(layer_groups(tensors), dimension))
    leaves = groups.select(F.concat_ws("#", "path", F.format_string("%05d", "layer_start"), "layer_type").alias("node_id"), F.col("path").alias("namespace"), "vector", "layer_type")
    sizes = leaves.groupBy("namespace").agg(F.greatest(F.lit(4), F.floor(F.count("*") / 3)).cast("int").alias("largest"))
    trees = None
    for row in sizes.select("largest").distinct().orderBy("largest").collect():  # a model has some dozens of groups: few different sizes
        own = leaves.join(sizes.filter(F.col("largest") == row.largest).select("namespace"), "namespace", "left_semi")
        tree = hierarchy(own, ClusterConfig(2, row.largest, 0.55, 4), content=None)
        trees = tree if trees is None else trees.unionByName(tree)
    if trees is None:
        return status, spark.createDataFrame([], "id string, model_id string, parent_id string, level int, layer_type string, vector array<double>")
    trees = written(trees)
    first = F.col("members")[0]
    named = trees.join(leaves.select(F.col("node_id").alias("first"), "layer_type"), F.when(F.col("depth") == 0, first) == F.col("first"), "left")
    nodes = named.select(F.concat_ws(":", "group", "cluster_id").alias("id"), F.col("group").alias("model_id"), F.when(F.col("parent_id").isNotNull(), F.concat_ws(":", "group", "parent_id")).alias("parent_id"), F.col("depth").alias("level"), F.coalesce("layer_type", F.lit("group")).alias("layer_type"), "vector")
    return status, nodes


def update_model(models: DataFrame, model_id: str, **changes: object) -> DataFrame:
    """models with the named columns of one model set, and its updated_at."""
    own = F.col("id") == model_id
    new = {k: F.when(own, F.lit(v)).otherwise(F.col(k)) for k, v in changes.items()}
    return models.withColumns(new | {"updated_at": F.when(own, F.current_timestamp()).otherwise(F.col("updated_at"))})


def update_parents(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Model nodes with new parents (child, parent); a child is named by its id or by the part of it behind the table's name."""
    from graphloom.functions.rules import thing_id

    short = F.when(F.contains("id", F.lit(":")), thing_id(F.col("id"))).otherwise(F.col("id"))
    found = nodes.select("id", F.explode(F.array_distinct(F.array("id", short))).alias("child")).join(parents, "child").groupBy("id").agg(F.max("parent").alias("_new"))
    return nodes.join(found, "id", "left").withColumn("parent_id", F.coalesce("_new", "parent_id")).drop("_new")
