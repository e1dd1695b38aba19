"""Greedy clustering by representatives, and hierarchies of clusters.

Pairs are taken by falling similarity (ties by lower ids). A pair of which an end is gone is passed over. Otherwise the second cluster joins the first, or, where that
would exceed the largest size, the second is dropped without its members joining anything. A merged cluster keeps its first member's
similarities. So one pass over the sorted pairs decides everything.

By which pair a cluster goes doesn't depend on sizes, only on whether the pair's first end is there still. `_narrowed` drops all pairs that can't decide, in DataFrames of any size, and leaves about two for
each node. Where a group's pairs fit a task by their count, at first or then, `_pass` scans the group in one; `_rounds` narrows the others on until each node has one pair or none, and adds up the sizes.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import written
from graphloom.functions.text import PART_BREAK, SOURCE_BREAK, ordered_text
from graphloom.functions.vectors import cosine, cosine_to
from graphloom.operators.search import average_pairwise, centroids, deciding_pairs

#: Pairs of a group that one task scans at most, and characters of a cluster's text.
TASK_PAIRS, MOST_TEXT = 500_000, 4000


@dataclass(frozen=True)
class ClusterConfig:
    least_size: int = 2
    largest_size: int = 10
    threshold: float = 0.5
    most_depth: int = 5

    def __post_init__(self):
        if self.least_size < 1 or self.largest_size < self.least_size or not 0 <= self.threshold <= 1 or self.most_depth < 0:
            raise ValueError("sizes, threshold or depth out of range")


def scan_pairs(a: list, b: list, order: np.ndarray, sizes: dict, largest: int) -> list[tuple]:
    """One pass over pairs in order: a decision (place of the pair, whether its second end joined, the size after) for each that is taken. sizes grow in place."""
    gone: set = set()
    made = []
    for k in order:
        i, j = a[k], b[k]
        if i in gone or j in gone:
            continue
        gone.add(j)
        fits = sizes.get(i, 1) + sizes.get(j, 1) <= largest
        if fits:
            sizes[i] = sizes.get(i, 1) + sizes.get(j, 1)
        made.append((k, fits, sizes.get(i, 1)))
    return made


def _log(kind: str) -> str:
    return f"id {kind}, other {kind}, fits boolean, similarity double, size long"


def _pass(pairs: DataFrame, largest: int) -> DataFrame:
    kind = dict(pairs.dtypes)["a"]

    def run(table: pa.Table) -> pa.Table:
        a, b, s = (table.column(c).to_pylist() for c in ("a", "b", "similarity"))
        sizes = dict(zip(a + b, table.column("size_a").to_pylist() + table.column("size_b").to_pylist(), strict=True))
        made = scan_pairs(a, b, sorted(range(len(a)), key=lambda k: (-s[k], a[k], b[k])), sizes, largest)
        end = table.schema.field("a").type
        columns = [[b[k] for k, _, _ in made], [a[k] for k, _, _ in made], [x for _, x, _ in made], [s[k] for k, _, _ in made], [x for _, _, x in made]]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (end, end, pa.bool_(), pa.float64(), pa.int64()), strict=True)], ["id", "other", "fits", "similarity", "size"])

    return pairs.groupBy("group").applyInArrow(run, _log(kind))


def _narrowed(left: DataFrame) -> DataFrame:
    """Pairs (a, b, rank, group, size_a, size_b, sure) without those that can't be the one by which b goes; sure: b goes by this pair.

    b goes by its first pair whose a is still there, whatever the sizes. So a is there before the first pair by which it could go itself: the first pair of b with such an a is the last that b needs. And where it
    is known by which pair a goes, later pairs of a fall away. About two pairs for each b stay after the first time, however many there were.
    """
    key = F.struct("rank", "a", "b")
    low = left.groupBy("b").agg(F.min(key).alias("low"), F.bool_or("sure").alias("known")).select(F.col("b").alias("a"), "low", "known")
    seen = left.join(low, "a", "left").withColumn("there", F.col("low").isNull() | (key < F.col("low"))).filter("there or not known")
    seen = written(seen.select(*left.columns, "there"))
    last = seen.groupBy("b").agg(F.min(F.when(F.col("there"), key)).alias("last"), F.min(key).alias("first"))
    kept = seen.drop("sure").join(last, "b").filter(F.col("last").isNull() | (key <= F.col("last")))
    return written(kept.select("a", "b", "rank", "group", "size_a", "size_b", F.coalesce(F.col("first") == F.col("last"), F.lit(False)).alias("sure")))


def _rounds(left: DataFrame, largest: int) -> DataFrame:
    """The same decisions by rounds, from narrowed pairs of all groups: first by which pair each node goes, then the sizes, from clusters that nothing joins upwards. There are as many rounds as
    decisions that wait for each other, not as pairs of a node."""
    while not left.filter("not sure").isEmpty():
        left = _narrowed(left)
    ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("size_a").alias("size")), F.struct(F.col("b").alias("id"), F.col("size_b").alias("size")))).alias("e"))
    own = written(ends.select("e.*").distinct())
    open_, made = written(left.select("a", "b", "rank")), []
    sizes = written(own.join(open_.select(F.col("a").alias("id")), "id", "left_anti"))  # nodes whose cluster is complete
    while not open_.isEmpty():
        ready = open_.join(sizes.select(F.col("id").alias("b"), "size"), "b", "left")
        joins = F.array_sort(F.collect_list(F.struct("rank", "b", "size")))
        whole = ready.groupBy("a").agg(joins.alias("joins"), F.count_if(F.col("size").isNull()).alias("missing")).filter("missing = 0").join(own.withColumnRenamed("id", "a"), "a")
        grow = F.expr(f"""aggregate(joins, struct(size AS size, cast(array() AS array<struct<fits: boolean, size: bigint>>) AS log), (s, x) -> struct(
          s.size + if(s.size + x.size <= {largest}, x.size, 0) AS size, array_append(s.log, struct(s.size + x.size <= {largest} AS fits, s.size + if(s.size + x.size <= {largest}, x.size, 0) AS size)) AS log))""")
        done = written(whole.select("a", "joins", grow.alias("g")).select("a", F.col("g.size").alias("size"), F.arrays_zip("joins", "g.log").alias("steps")))
        made.append(done.select(F.col("a").alias("other"), F.explode("steps").alias("s")).select(F.col("s.joins.b").alias("id"), "other", F.col("s.log.fits").alias("fits"), (-F.col("s.joins.rank")).alias("similarity"), F.col("s.log.size").alias("size")))
        sizes = done.select(F.col("a").alias("id"), "size").unionByName(sizes.join(open_.select(F.col("b").alias("id")), "id", "left_semi"))
        sizes, open_ = written(sizes), written(open_.join(done.select("a"), "a", "left_anti"))
    return functools.reduce(DataFrame.unionByName, made) if made else left.sparkSession.createDataFrame([], _log(dict(left.dtypes)["a"]))


def decisions(pairs: DataFrame, largest: int, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """A row for each node that is no cluster's first member any more: id, other (the first end of the deciding pair), fits (whether id joined it; else id is dropped), similarity, and the size of other's
    cluster then. Pairs may bring sizes that their ends have already (size_a, size_b). Groups whose pairs fit a task, all or narrowed, are scanned in one each, larger ones go by rounds."""
    for c in ("size_a", "size_b"):
        if c not in pairs.columns:
            pairs = pairs.withColumn(c, F.lit(1).cast("long"))
    pairs = written(pairs.select("a", "b", "group", "similarity", "size_a", "size_b"))
    sizes = pairs.groupBy("group").count()
    if (sizes.agg(F.max("count")).first()[0] or 0) <= task_pairs:
        return written(_pass(pairs, largest))
    same = F.col("group").eqNullSafe(F.col("large"))
    over = lambda rows: written(rows.groupBy(F.col("group").alias("large")).count().filter(F.col("count") > task_pairs).select("large"))
    large = over(pairs)
    near = _narrowed(pairs.join(large, same, "left_semi").select("a", "b", (-F.col("similarity")).alias("rank"), "group", "size_a", "size_b", F.lit(False).alias("sure")))
    still = over(near)
    few = pairs.join(large, same, "left_anti").unionByName(near.join(still, same, "left_anti").withColumn("similarity", -F.col("rank")).select(*pairs.columns))
    return written(_pass(few, largest).unionByName(_rounds(near.join(still, same, "left_semi"), largest)))


def resolved(placed: DataFrame, decided: DataFrame, config: ClusterConfig) -> DataFrame:
    """group, id and cluster of rows (group, id) by the decisions on them. Clusters below the least size keep their first member alone; members of dropped clusters are in none."""
    into = decided.select("id", F.when(F.col("fits"), F.col("other")).alias("into"), F.lit(True).alias("decided"))
    found = written(placed.join(into, "id", "left").select("group", "id", F.when(F.col("decided").isNull(), F.col("id")).otherwise(F.col("into")).alias("cluster")))
    while True:  # a cluster may have joined another in turn; dropped ones lead to null
        up = found.select(F.col("id").alias("cluster"), F.col("cluster").alias("next"))
        ahead = found.join(up, "cluster", "left")
        moved = written(ahead.select("group", "id", "cluster", "next"))
        if moved.filter("cluster is not null and not (cluster <=> next)").isEmpty():
            break
        found = moved.select("group", "id", F.col("next").alias("cluster"))
    kept = found.filter("cluster is not null")
    sizes = kept.groupBy("cluster").agg(F.count("*").alias("members"))
    return kept.join(sizes, "cluster").filter((F.col("members") >= config.least_size) | (F.col("id") == F.col("cluster"))).select("group", "id", "cluster")


def clusters(rows: DataFrame, config: ClusterConfig = ClusterConfig(), group: str = "namespace", id_col: str = "node_id", task_pairs: int = TASK_PAIRS) -> DataFrame:
    """group, id and cluster (the id of its first member) of every member that a cluster keeps, see resolved()."""
    decided = decisions(deciding_pairs(rows, config.threshold, group, id_col), config.largest_size, task_pairs)
    return resolved(rows.select(F.col(group).alias("group"), F.col(id_col).alias("id")), decided, config)


def merged(found: DataFrame) -> DataFrame:
    """Rows of found (group, id, first) in clusters of two or more, as levels above the lowest have them."""
    sizes = found.groupBy("first").agg(F.count("*").alias("n")).filter("n > 1")
    return found.join(sizes.select("first"), "first", "left_semi")


def _cut(text, most: int | None):
    return text if most is None else F.left(text, F.lit(most))


def described(items: DataFrame, found: DataFrame, depth: int, most_text: int | None = MOST_TEXT) -> DataFrame:
    """The clusters of a level: group, first, cluster_id, depth, members, vector (their mean), text (the first most_text characters of theirs, or all), internal_similarity. items: group, id, vector, text."""
    placed = items.join(found.select("id", "first"), "id")
    texts = placed.groupBy("group", "first").agg(_cut(ordered_text(F.col("id"), F.coalesce("text", F.lit("")), PART_BREAK if depth == 0 else SOURCE_BREAK), most_text).alias("text"), F.array_sort(F.collect_list("id")).alias("members"))
    level = texts.join(centroids(placed, "first").select("first", "centroid"), "first").join(average_pairwise(placed, "first", "id").select("first", "average_similarity"), "first", "left")
    name = F.concat(F.lit(f"{depth}:"), F.regexp_replace("first", r"^\d+:", "") if depth else F.col("first"))
    return level.select("group", "first", name.alias("cluster_id"), F.lit(depth).alias("depth"), "members", F.col("centroid").alias("vector"), "text", F.coalesce("average_similarity", F.lit(1.0)).alias("internal_similarity"))


def lowest_items(rows: DataFrame, group: str, id_col: str, content: str | None, most_text: int | None = MOST_TEXT) -> DataFrame:
    text = _cut(F.col(content), most_text) if content else F.lit("")
    return rows.select(F.col(group).alias("group"), F.col(id_col).cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"), text.alias("text"))


def next_items(level: DataFrame) -> DataFrame:
    """A level's clusters as the items of the next one, in groups of more than one."""
    alive = level.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1")
    return level.join(alive.select("group"), "group", "left_semi").select("group", F.col("cluster_id").alias("id"), "vector", "text")


def hierarchy(rows: DataFrame, config: ClusterConfig = ClusterConfig(), group: str = "namespace", id_col: str = "node_id", content: str | None = "content", most_text: int | None = MOST_TEXT) -> DataFrame:
    """The tree of each group: group, cluster_id (depth:first), depth, members, children, parent_id, vector (the mean), text (all its members', or the first most_text characters), internal_similarity, is_root. Without content, texts are empty.

    Depth 0 holds clusters of nodes. Each level's clusters of two or more become the next level's nodes, whose vectors are the mean of their children's; single clusters fall out.
    Levels end at one cluster, at the depth limit (0: none), or where nothing merges; the last level's clusters are roots.
    """
    items, levels, depth = lowest_items(rows, group, id_col, content, most_text), [], 0
    while True:
        items = written(items)
        found = clusters(items, config, "group", "id").withColumnRenamed("cluster", "first")
        found = written((merged(found) if depth else found).select("group", "id", "first"))
        if found.isEmpty():
            break
        levels.append(written(described(items, found, depth, most_text)))
        items = next_items(levels[-1])
        depth += 1
        if config.most_depth and depth > config.most_depth or items.isEmpty():
            break
    return tree_of(rows.sparkSession, levels)


def tree_of(spark: SparkSession, levels: list[DataFrame]) -> DataFrame:
    """The tree of described levels; see hierarchy()."""
    if not levels:
        return spark.createDataFrame([], "`group` string, cluster_id string, depth int, members array<string>, children array<string>, parent_id string, vector array<double>, text string, internal_similarity double, is_root boolean")
    out = written(functools.reduce(DataFrame.unionByName, levels))
    parents = out.filter("depth > 0").select(F.explode("members").alias("cluster_id"), F.col("cluster_id").alias("parent_id"))
    last = out.groupBy("group").agg(F.max("depth").alias("last"))
    none = F.expr("cast(array() as array<string>)")
    return out.join(parents, "cluster_id", "left").join(last, "group").select("group", "cluster_id", "depth", F.when(F.col("depth") == 0, F.col("members")).otherwise(none).alias("members"), F.when(F.col("depth") > 0, F.col("members")).otherwise(none).alias("children"), "parent_id", "vector", "text", "internal_similarity", (F.col("depth") == F.col("last")).alias("is_root"))


def tree_stats(tree: DataFrame) -> DataFrame:
    """Per group and depth: clusters, mean size and mean internal similarity."""
    size = F.when(F.col("depth") == 0, F.size("members")).otherwise(F.size("children"))
    return tree.groupBy("group", "depth").agg(F.count("*").alias("clusters"), F.round(F.avg(size), 6).alias("average_size"), F.round(F.avg("internal_similarity"), 6).alias("average_internal_similarity"))


def _recursive(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """The rows of a recursive query, written: one plan for all levels, whose rows have no limit."""
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return written(spark.sql(text, **tables))
    finally:
        spark.conf.set(limit, before)


def path_to_root(tree: DataFrame) -> DataFrame:
    """cluster_id and path, the ids from it up to its root."""
    walk = """WITH RECURSIVE walk AS (SELECT cluster_id, array(cluster_id) AS path, parent_id AS next FROM {edges}
      UNION ALL SELECT w.cluster_id, concat(w.path, array(e.cluster_id)), e.parent_id FROM walk w JOIN {edges} e ON e.cluster_id = w.next)
    SELECT cluster_id, path FROM walk WHERE next IS NULL"""
    return _recursive(tree.sparkSession, walk, edges=written(tree.select("cluster_id", "parent_id")))


def traverse(tree: DataFrame, query: list[float], least: float) -> DataFrame:
    """Clusters reached from the roots through clusters that are similar to the query at or above a threshold."""
    scored = written(tree.withColumn("similarity", F.round(cosine_to(F.col("vector"), query), 6)).filter(F.col("similarity") >= least).select("group", "cluster_id", "parent_id", "depth", "similarity", "is_root"))
    walk = """WITH RECURSIVE walk AS (SELECT `group`, cluster_id, depth, similarity FROM {scored} WHERE is_root
      UNION ALL SELECT s.`group`, s.cluster_id, s.depth, s.similarity FROM walk w JOIN {scored} s ON s.parent_id = w.cluster_id)
    SELECT `group`, cluster_id, depth, similarity FROM walk"""
    return _recursive(tree.sparkSession, walk, scored=scored)


def sibling_edges(tree: DataFrame, least: float = 0.5) -> DataFrame:
    """Semantic edges between children of one parent whose vectors are similar enough; a parent has at most the largest cluster size of children."""
    child = tree.filter("parent_id is not null").select("parent_id", "cluster_id", "vector")
    a, b = child.select("parent_id", F.col("cluster_id").alias("src"), F.col("vector").alias("x")), child.select("parent_id", F.col("cluster_id").alias("dst"), F.col("vector").alias("y"))
    pairs = a.join(b, "parent_id").filter("src < dst").withColumn("similarity", F.round(cosine(F.col("x"), F.col("y")), 6)).filter(F.col("similarity") >= least)
    return pairs.select("parent_id", "src", "dst", F.lit("semantic").alias("edge_type"), "similarity", F.round(1 / F.col("similarity"), 6).alias("weight"))


def tree_nodes(tree: DataFrame, summary_length: int = 500) -> tuple[DataFrame, DataFrame]:
    """Parent nodes and their edges to children, ready to be stored: a leaf cluster is represented by its first member; parents are those of depth 1 and more. Building again gives the same ids."""
    from graphloom.functions.text import shorten

    leaf = F.when(F.col("depth") == 0, F.col("members")[0]).otherwise(F.col("cluster_id"))
    known = tree.select("cluster_id", leaf.alias("node_id"), F.col("vector").alias("own"), F.col("parent_id").alias("up"))
    nodes = tree.filter("depth > 0").select(F.col("cluster_id").alias("node_id"), F.lit("parent").alias("node_type"), F.lit("complete").alias("status"), shorten(F.col("text"), 2 * summary_length).alias("content"), "vector", F.col("depth").alias("depth_level"), F.lit(0.85).alias("confidence"), F.col("group").alias("namespace"), F.lit("fractal_builder").alias("source"), F.array(F.concat(F.lit("depth:"), "depth"), F.concat(F.lit("children:"), F.size("children")), F.concat(F.lit("cluster:"), "cluster_id")).alias("tags"))
    parents = tree.filter("depth > 0").select(F.col("cluster_id").alias("up"), F.col("vector").alias("parent_vector"), F.col("group").alias("namespace"))
    edges = known.filter("up is not null").join(parents, "up").withColumn("similarity", F.round(F.coalesce(cosine(F.col("own"), F.col("parent_vector")), F.lit(0.8)), 6))
    return nodes, edges.select(F.col("up").alias("src"), F.col("node_id").alias("dst"), "namespace", F.lit("parentchild").alias("edge_type"), "similarity", F.round(1 / F.col("similarity"), 6).alias("weight"), F.lit(1.0).alias("confidence"))


def similar_leaf(tree: DataFrame, query: list[float]) -> DataFrame:
    """The leaf cluster of each group whose vector is most similar to the query, ties by id."""
    scored = tree.filter("depth = 0").withColumn("similarity", F.round(cosine_to(F.col("vector"), query), 6))
    best = scored.groupBy("group").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "cluster_id")).alias("b"))
    return best.select("group", "b.cluster_id", (-F.col("b.s")).alias("similarity"))
