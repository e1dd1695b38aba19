"""Exact vector search through a tree of balls, stored beside the vectors.

Rows are dealt to balls from above: pivots of each level, drawn by a hash, divide the rows of the ball above them, each row going to the most similar one. A ball keeps its pivot, its size and
its spread, the least cosine of any of its rows to the pivot. Angles between vectors obey the triangle inequality, so no row of a ball can be more similar to a query than its bound, and
balls whose bound is below what a query still wants are skipped with all that is below them. Building is a join of one level with the next, and queries meet balls and rows by blocks, so
neither a level nor a ball has to fit a task.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.common import partitions, written
from graphloom.functions.vectors import cosine, norm
from graphloom.operators.search import QUERY_BLOCK, VECTOR_BLOCK, _unit, top_k_each

#: Rows for each ball of the lowest level, and balls for each one of the level above, on average.
LEAF_ROWS, FANOUT = 256, 64
#: Rows of a section, a ball whose leaves are bounded and compared in one task, at most on average.
SECTION_ROWS = 2048
#: Leaves in which a search learns what it wants at least.
PROBES = 4
#: Similarities are rounded to six places; bounds give way by more than that.
SLACK = 2e-6


class MetricIndex(NamedTuple):
    """rows: group, leaf, id, vector; balls: level, ball, parent, pivot, spread, size. The lowest level, 1, has the leaves; a leaf without pivot holds what has no angle and is never skipped."""

    rows: DataFrame
    balls: DataFrame
    depth: int

    def save(self, folder: str) -> None:
        """Rows lie in order of their leaves, so that reading few of them opens few files."""
        self.rows.repartitionByRange(partitions(self.rows), "leaf").sortWithinPartitions("leaf").write.parquet(f"{folder}/rows")
        self.balls.write.parquet(f"{folder}/balls")
        spark = self.rows.sparkSession
        spark.createDataFrame([(json.dumps({"depth": self.depth}),)], "value string").coalesce(1).write.text(f"{folder}/shape")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> MetricIndex:
        shape = json.loads(spark.read.text(f"{folder}/shape").first().value)
        return cls(spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/balls"), shape["depth"])


def build(rows: DataFrame, group: str | None = None, id_col: str = "node_id", vector: str = "vector", leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT) -> MetricIndex:
    """The index of all rows; with group, one tree for each. Ids are unique. Vectors that are null or zero, or of another dimension than the longest of their group, are in leaves without pivot."""
    own = F.col(group).cast("string") if group else F.lit("")
    base = rows.select(own.alias("group"), F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    sizes = base.groupBy(F.col("group").alias("own")).agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dimension"), F.min(F.xxhash64("id")).alias("least"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    depth = 1 + max(0, math.ceil(math.log(max(1, most / leaf_rows), fanout)) - 1)
    h = F.xxhash64("id")
    drawn = F.lit(0)
    for level in range(1, depth + 1):
        drawn = F.when((F.pmod(h, F.lit(leaf_rows * fanout ** (level - 1))) == 0), level).otherwise(drawn)
    full = (F.size("vector") == F.col("dimension")) & (norm(F.col("vector")) > 0)
    base = written(base.join(sizes, F.col("group").eqNullSafe(F.col("own"))).select("group", "id", "vector", drawn.alias("drawn"), F.coalesce(full, F.lit(False)).alias("full")))
    # every group has a pivot of all levels: the sound row with the least hash
    first = base.filter("full").groupBy(F.col("group").alias("own")).agg(F.min_by("id", F.xxhash64("id")).alias("first")).select("first", F.lit(True).alias("top"))
    now = base.filter("full").join(first, F.col("id") == F.col("first"), "left").select("group", "id", "vector", F.when(F.col("top"), depth).otherwise(F.col("drawn")).alias("drawn"), _root(F.col("group")).alias("parent"))
    now = written(now)
    balls = None
    for level in range(depth, 0, -1):
        pivots = now.filter(F.col("drawn") >= level)
        placed = top_k_each(pivots, now.filter(F.col("drawn") < level).withColumnRenamed("id", "row"), 1, "id", "vector", "row", "parent")
        placed = placed.select(F.col("row").alias("own"), F.col("id").alias("pivot_id"), "similarity").unionByName(pivots.select(F.col("id").alias("own"), F.col("id").alias("pivot_id"), F.lit(1.0).alias("similarity")))
        placed = written(placed)
        name = F.concat(F.lit(f"{level}:"), F.col("pivot_id").cast("string"))
        spread = placed.groupBy("pivot_id").agg(F.min("similarity").alias("spread"), F.count("*").alias("size"))
        found = written(spread.join(pivots, F.col("pivot_id") == F.col("id")).select(F.lit(level).alias("level"), name.alias("ball"), "parent", F.col("vector").alias("pivot"), (F.col("spread") - SLACK).alias("spread"), "size"))
        balls = found if balls is None else balls.unionByName(found)
        now = written(now.join(placed, F.col("id") == F.col("own")).select("group", "id", "vector", "drawn", name.alias("parent")))
    flat = base.filter("not full")
    none = flat.groupBy("group").agg(F.count("*").alias("size")).select(F.lit(1).alias("level"), _flat(F.col("group")).alias("ball"), _root(F.col("group")).alias("parent"), F.lit(None).cast(dict(base.dtypes)["vector"]).alias("pivot"), F.lit(-1.0).alias("spread"), "size")
    leaves = now.select("group", F.col("parent").alias("leaf"), "id", "vector").unionByName(flat.select("group", _flat(F.col("group")).alias("leaf"), "id", "vector"))
    return MetricIndex(written(leaves), written(balls.unionByName(none)), depth)


def _root(group: Column) -> Column:
    return F.concat(F.lit("root:"), F.coalesce(group, F.lit("")))


def _flat(group: Column) -> Column:
    return F.concat(F.lit("flat:"), F.coalesce(group, F.lit("")))


def bound(query: Column, pivot: Column, spread: Column) -> Column:
    """The most that the cosine of a query and any row of a ball can be: cos(a - r), with a the angle between query and pivot and r that of the spread; 1 where the query is within the ball or has no angle."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(query, pivot)))
    s = F.greatest(F.lit(-1.0), spread)
    away = c * s + F.sqrt((1 - c * c) * (1 - s * s))
    return F.when(pivot.isNull() | (F.size(query) != F.size(pivot)) | (norm(query) == 0) | (c >= s), 1.0).otherwise(away)


def _within(vectors: pa.Array, wanted: np.ndarray, pivots: pa.Array, spreads: pa.Array) -> np.ndarray:
    """For queries and balls, whether the ball may hold a row at or above what the query wants. A ball comes with those above it (pivots and spreads of its chain, one after the other), of which none may rule it out: bound() as products of matrices."""
    many = len(spreads[0])
    chain = pivots.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(pivots), many, -1)
    s = np.maximum(-1.0, spreads.flatten().to_numpy(zero_copy_only=False).reshape(len(pivots), many))
    unit = _unit(vectors, chain.shape[2])
    flat = ~unit.any(1)
    out = np.ones((len(unit), len(pivots)), bool)
    for k in range(many):
        p = chain[:, k]
        c = np.clip(unit @ (p / np.sqrt((p * p).sum(1, keepdims=True))).T, -1.0, 1.0)
        most = np.where(c >= s[:, k], 1.0, c * s[:, k] + np.sqrt((1 - c * c) * (1 - s[:, k] * s[:, k])))
        out &= (most >= wanted[:, None] - SLACK) | flat[:, None]
    return out


def _asked(index: MetricIndex, queries: DataFrame, group: str | None, query_id: str, vector: str) -> DataFrame:
    own = F.col(group).cast("string") if group else F.lit("")
    return queries.filter(F.col(vector).isNotNull()).select(F.col(query_id).alias("query"), F.col(vector).alias("vector"), _root(own).alias("at"), _flat(own).alias("flat"))


def _chains(index: MetricIndex, top: int, low: int) -> DataFrame:
    """at (the ball above level top, or the root), ball, pivots and spreads for each ball of level low: its own and those of the balls above it, from level top on."""
    level = lambda k: index.balls.filter((F.col("level") == k) & F.col("pivot").isNotNull()).select("parent", F.col("ball").alias("below"), "pivot", "spread")
    out = level(top).select(F.col("parent").alias("at"), F.col("below").alias("ball"), F.col("pivot").alias("pivots"), F.array("spread").alias("spreads"))
    for k in range(top - 1, low - 1, -1):
        out = out.join(level(k), F.col("ball") == F.col("parent")).select("at", F.col("below").alias("ball"), F.concat("pivots", "pivot").alias("pivots"), F.concat("spreads", F.array("spread")).alias("spreads"))
    return out


def _dealt(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, compare, made: str, n: int) -> DataFrame:
    """compare() for each block of left and right with one key: sizes (own, x, y) has the numbers of blocks; rows of both have `part`, by which they are dealt. Rows of left without part go to every block."""
    sides = (left.join(sizes, F.col(key) == F.col("own")), right.join(sizes, F.col(key) == F.col("own")))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    own = F.when(F.col("part").isNull(), F.sequence(F.lit(0), F.col("x") - 1)).otherwise(F.array(F.pmod("part", "x").cast("int")))
    a = sides[0].withColumn("i", F.explode(own)).withColumn("j", every("y")).drop("own", "x", "y", "part")
    b = sides[1].withColumn("j", F.pmod("part", "y").cast("int")).withColumn("i", every("x")).drop("own", "x", "y", "part")
    deal = lambda df: df.repartition(n, key, "i", "j").groupBy(key, "i", "j")
    return deal(a).cogroup(deal(b)).applyInArrow(compare, made)


def _searched(index: MetricIndex, asked: DataFrame, k: int | None, least: float = -1.0) -> DataFrame:
    """query, id, similarity of the k best rows of each part of the index that asked (query, vector, wanted, at, flat) has to look into, or of all at or above least; and rows (query, compared) of what that took.

    Balls of some SECTION_ROWS rows are sections. First queries meet all sections of their root by blocks, then the rows of those that may hold what they want; the bounds of a section's leaves are taken there.
    So bounds and similarities are products of matrices, and no row is made for a query and a leaf.
    """
    sizes = {r.level: r.size for r in index.balls.filter("pivot is not null").groupBy("level").agg(F.avg("size").alias("size")).collect()}  # a row for each level
    top = max([1, *(k for k, size in sizes.items() if size <= SECTION_ROWS)])
    kind, id_kind, n = dict(asked.dtypes)["query"], dict(index.rows.dtypes)["id"], partitions(index.rows)
    blocks = lambda df, key, size, name: df.groupBy(F.col(key).alias("own")).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    part = lambda c: F.xxhash64(c).alias("part")
    sections = written(_chains(index, index.depth, top).select("at", F.col("ball").alias("section"), "pivots", "spreads"))

    def route(a: pa.Table, b: pa.Table) -> pa.Table:
        x = y = np.zeros(0, int)
        if a.num_rows and b.num_rows:
            x, y = np.nonzero(_within(b.column("vector").combine_chunks(), b.column("wanted").to_numpy(), a.column("pivots").combine_chunks(), a.column("spreads").combine_chunks()))
        return pa.table({"query": b.column("query").combine_chunks().take(pa.array(x)), "section": a.column("section").combine_chunks().take(pa.array(y))})

    ends = blocks(sections, "at", VECTOR_BLOCK, "x").join(blocks(asked, "at", QUERY_BLOCK, "y"), "own")
    near = _dealt(sections.select("at", "section", "pivots", "spreads", part("section")), asked.select("at", "query", "vector", "wanted", part("query")), "at", ends, route, f"query {kind}, section string", n)
    flat = asked.join(index.balls.filter("pivot is null").select(F.col("ball").alias("flat")), "flat").select("query", F.col("flat").alias("section"))
    near = written(near.unionByName(flat))

    vectors = dict(index.rows.dtypes)["vector"]
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    lower = written(_chains(index, top - 1, 1).select(F.col("at").alias("section"), F.col("ball").alias("leaf"), "pivots", "spreads")) if top > 1 else None
    rows = index.rows.select(F.col("leaf").alias("section"), "leaf", "id", "vector") if lower is None else index.rows.join(lower.select("section", F.col("leaf").alias("l")), F.col("leaf") == F.col("l"), "left").select(F.coalesce("section", "leaf").alias("section"), "leaf", "id", "vector")
    rows = written(rows.select("section", "leaf", "id", "vector", none("pivots", vectors), none("spreads", "array<double>"), part("id")))
    ends = blocks(rows, "section", VECTOR_BLOCK, "x").join(blocks(near, "section", QUERY_BLOCK, "y"), "own")
    left = rows if lower is None else rows.unionByName(lower.select("section", "leaf", none("id", id_kind), none("vector", vectors), "pivots", "spreads", none("part", "long")))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        schema = pa.schema([b.schema.field("query"), a.schema.field("id"), pa.field("similarity", pa.float64()), pa.field("compared", pa.int64())])
        tell = lambda q, ids, s, seen: found.append(pa.Table.from_arrays([names.take(pa.array(q)), ids, pa.array(s, pa.float64()), pa.array(seen, pa.int64())], schema=schema))
        own = a.filter(pc.is_valid(a.column("id")))
        if own.num_rows and b.num_rows:
            balls, names, wanted = a.filter(pc.is_valid(a.column("spreads"))), b.column("query").combine_chunks(), b.column("vector").combine_chunks()
            order = np.argsort(np.array(own.column("id").to_pylist()))  # ties by id: the first of equal scores
            ids, vectors = own.column("id").combine_chunks().take(pa.array(order)), own.column("vector").combine_chunks().take(pa.array(order))
            may = np.ones((len(names), len(ids)), bool)
            if balls.num_rows:
                at = pc.index_in(own.column("leaf").combine_chunks(), balls.column("leaf").combine_chunks()).to_numpy(zero_copy_only=False)[order].astype(int)
                may = _within(wanted, b.column("wanted").to_numpy(), balls.column("pivots").combine_chunks(), balls.column("spreads").combine_chunks())[:, at]
            tell(np.arange(len(names)), pa.nulls(len(names), ids.type), [None] * len(names), may.sum(1))
            lengths = pc.fill_null(pc.list_value_length(wanted), 0).to_numpy(zero_copy_only=False)
            for dimension in np.unique(lengths).tolist():  # one, as a rule
                some = np.flatnonzero(lengths == dimension)
                s = np.where(may[some], np.round(_unit(wanted.take(pa.array(some)), dimension) @ _unit(vectors, dimension).T, 6), -np.inf)
                if k is None:
                    x, y = np.nonzero(s >= least)
                else:
                    many = min(k, s.shape[1])
                    last = -np.partition(-s, many - 1, axis=1)[:, many - 1 : many]
                    above = s > last
                    same = (s == last) & (s > -np.inf)
                    x, y = np.nonzero(above | (same & (np.cumsum(same, axis=1) <= many - above.sum(1, keepdims=True))))
                tell(some[x], ids.take(pa.array(y)), s[x, y], [None] * len(x))
        return pa.concat_tables(found) if found else schema.empty_table()

    queries = near.join(asked.select("query", "vector", "wanted"), "query").select("section", "query", "vector", "wanted", part("query"))
    return written(_dealt(left, queries, "section", ends, compare, f"query {kind}, id {id_kind}, similarity double, compared long", n))


def probed(index: MetricIndex, asked: DataFrame, k: int) -> DataFrame:
    """asked with `wanted`: the k-th best similarity in the PROBES leaves that lie nearest on the way down, -1 where they have fewer rows. k rows at least are as similar as that."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("c"), "ball"))
    step = asked.select("query", "vector", "at")
    for level in range(index.depth, 0, -1):
        below = index.balls.filter((F.col("level") == level) & F.col("pivot").isNotNull()).select("parent", "ball", "pivot")
        scored = step.join(below, F.col("at") == F.col("parent")).select("query", "vector", "ball", cosine(F.col("vector"), F.col("pivot")).alias("c"))
        step = written(scored.withColumn("place", place).filter(F.col("place") <= PROBES).select("query", "vector", F.col("ball").alias("at")))
    found = top_k_each(index.rows, step.withColumnRenamed("at", "leaf"), k, "id", "vector", "query", "leaf")
    kth = found.filter(F.col("rank") == k).select("query", F.col("similarity").alias("kth"))
    return asked.join(kth, "query", "left").withColumn("wanted", F.coalesce("kth", F.lit(-1.0))).drop("kth")


def indexed_top_k(index: MetricIndex, queries: DataFrame, k: int, group: str | None = None, id_col: str = "node_id", vector: str = "vector", query_id: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """The k nearest rows of every query as top_k_each gives them, and what the search cost: query, rows and compared (rows of the leaves that weren't skipped). Query ids are unique; queries without vector find nothing."""
    asked = written(probed(index, _asked(index, queries, group, query_id, vector), k))
    seen = _searched(index, asked, k)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    found = seen.filter("compared is null").withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select(F.col("query").alias(query_id), F.col("id").alias(id_col), "similarity", "rank"), _cost(index, asked, seen, query_id)


def indexed_range(index: MetricIndex, queries: DataFrame, least: float, group: str | None = None, id_col: str = "node_id", vector: str = "vector", query_id: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """All rows at or above a similarity for every query, and what the search cost, see indexed_top_k."""
    asked = written(_asked(index, queries, group, query_id, vector).withColumn("wanted", F.lit(float(least))))
    seen = _searched(index, asked, None, least)
    return seen.filter("compared is null").select(F.col("query").alias(query_id), F.col("id").alias(id_col), "similarity"), _cost(index, asked, seen, query_id)


def _cost(index: MetricIndex, asked: DataFrame, seen: DataFrame, query_id: str) -> DataFrame:
    compared = seen.filter("compared is not null").groupBy("query").agg(F.sum("compared").alias("compared"))
    all_rows = index.rows.groupBy(_root(F.col("group")).alias("at")).agg(F.count("*").alias("rows"))
    out = asked.select("query", "at").join(all_rows, "at").join(compared, "query", "left")
    return out.select(F.col("query").alias(query_id), "rows", F.coalesce("compared", F.lit(0)).cast("long").alias("compared"))
