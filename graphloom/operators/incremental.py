"""Hierarchies that grow: arriving rows change the decisions that they can change, and the clusters above those.

A level keeps its items, their pairs and the log of decisions. Decisions are made in the order of the pairs, so within a component of the graph of pairs all that were made before the first
pair that comes or goes stand. The rest of the component is decided again, from the sizes that the log's beginning leaves. Clusters of which a member changed are described again,
and are what comes and goes one level above. So the work of a batch is the pairs of its own rows and the ends of the components that they touch, and other components aren't read for it.
Where a group is large, a level has only the pairs that can decide, about two for each item, and a batch looks up again those of the items whose last pair it made unsure.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import written
from graphloom.operators import search
from graphloom.operators.cluster import ClusterConfig, decisions, described, lowest_items, merged, next_items, resolved, tree_of
from graphloom.operators.search import deciding_pairs, largest_group, more_deciding_pairs, similar_pairs, top_k_each

ITEMS, PAIRS, LOG, FOUND = "`group` string, id string, vector array<double>, text string", "a string, b string, `group` string, similarity double", "id string, other string, fits boolean, similarity double, size long", "`group` string, id string, first string"
CLUSTERS = "`group` string, first string, cluster_id string, depth int, members array<string>, vector array<double>, text string, internal_similarity double"


class Level(NamedTuple):
    items: DataFrame
    pairs: DataFrame
    log: DataFrame
    found: DataFrame
    clusters: DataFrame

    def save(self, folder: str) -> None:
        for name, df in self._asdict().items():
            df.write.parquet(f"{folder}/{name}")


def _empty(spark: SparkSession) -> Level:
    return Level(*(spark.createDataFrame([], x) for x in (ITEMS, PAIRS, LOG, FOUND, CLUSTERS)))


class Growing(NamedTuple):
    """A hierarchy by levels, and what the last batch took: a row (depth, pairs, redone) for each level it reached."""

    levels: list[Level]
    work: list[tuple[int, int, int]]

    def tree(self, spark: SparkSession) -> DataFrame:
        """What hierarchy() gives for all rows so far."""
        return tree_of(spark, [x.clusters for x in self.levels if not x.clusters.isEmpty()])

    def save(self, folder: str) -> None:
        for depth, level in enumerate(self.levels):
            level.save(f"{folder}/{depth}")

    @classmethod
    def open(cls, spark: SparkSession, folder: str, depth: int) -> Growing:
        return cls([Level(*(spark.read.parquet(f"{folder}/{k}/{name}") for name in Level._fields)) for k in range(depth)], [])


def new_pairs(items: DataFrame, added: DataFrame, least: float) -> DataFrame:
    """Pairs at or above a threshold that have an added item, each once."""
    sound = items.filter("vector is not null")
    hits = top_k_each(sound, added.filter("vector is not null").select(F.col("id").alias("query"), "group", "vector"), None, "id", "vector", "query", "group", least).filter("query != id")
    named = hits.join(added.select(F.col("id").alias("query"), "group"), "query")
    return named.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"), "group", "similarity").dropDuplicates(["a", "b"])


def _key():
    return F.struct((-F.col("similarity")).alias("rank"), "a", "b")


def cuts(pairs: DataFrame, changed: DataFrame) -> DataFrame:
    """id and cut, the first changed pair of its component, for all nodes of components with one. Each round passes on only what became less."""
    both = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    least = lambda df: df.groupBy("id").agg(F.min("cut").alias("cut"))
    known = step = written(least(changed.select(F.explode(F.array("a", "b")).alias("id"), _key().alias("cut"))))
    while not step.isEmpty():
        reached = least(both.join(step.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id"), "cut"))
        step = written(reached.join(known.select("id", F.col("cut").alias("old")), "id", "left").filter("old is null or cut < old").select("id", "cut"))
        known = written(least(known.unionByName(step)))
    return known


def grow_level(old: Level, added: DataFrame, gone: DataFrame, depth: int, config: ClusterConfig) -> tuple[Level, DataFrame, tuple[int, int, int]]:
    """The level after some ids are gone and items are added (one that changes is both); the first members of clusters that were described again or fell away; its work."""
    if old.items.isEmpty():  # nothing that could stand
        pairs = written(deciding_pairs(added, config.threshold, "group", "id").select("a", "b", "group", "similarity"))
        log = decisions(pairs, config.largest_size)
        found = resolved(added.select("group", "id"), log, config).withColumnRenamed("cluster", "first")
        found = written((merged(found) if depth else found).select("group", "id", "first"))
        size = pairs.count()
        return Level(added, pairs, log, found, written(described(added, found, depth))), found.select("first").distinct(), (depth, size, size)
    without = lambda df, *ends: df.join(gone.withColumnRenamed("id", ends[0]), ends[0], "left_anti") if len(ends) == 1 else without(without(df, ends[0]), ends[1])
    items = written(without(old.items, "id").unionByName(added))
    kept = written(without(old.pairs, "a", "b"))
    lost = written(old.pairs.join(kept.select("a", "b"), ["a", "b"], "left_anti"))
    was, now = largest_group(old.items), largest_group(items)
    if now > search.NARROW_ROWS:
        fresh = more_deciding_pairs(items, added, without(old.pairs, "b"), kept, config.threshold)
    elif was > search.NARROW_ROWS:  # the level had only pairs that can decide, and has all from now on
        fresh = similar_pairs(items, config.threshold, "group", "id")
    else:
        fresh = new_pairs(items, added, config.threshold)
    fresh = written(fresh.select("a", "b", "group", "similarity").join(kept.select("a", "b"), ["a", "b"], "left_anti").select(*kept.columns))
    pairs = written(kept.unionByName(fresh))
    cut = cuts(pairs.unionByName(lost), fresh.unionByName(lost))
    late = lambda df: df.filter((F.struct((-F.col("similarity")).alias("rank"), "a", "b") >= F.col("cut")))
    log = old.log.join(cut, "id", "left").withColumns({"a": F.col("other"), "b": F.col("id")})
    early = written(log.filter(F.col("cut").isNull() | (_key() < F.col("cut"))).select(*old.log.columns, F.col("cut").isNotNull().alias("touched")))
    before = early.filter("touched")
    sizes = written(before.filter("fits").groupBy("other").agg(F.max("size").alias("size")))
    redo = late(pairs.join(cut.withColumnRenamed("id", "a"), "a")).join(before.select(F.col("id").alias("a")), "a", "left_anti").join(before.select(F.col("id").alias("b")), "b", "left_anti")
    for end in ("a", "b"):
        redo = redo.join(sizes.select(F.col("other").alias(end), F.col("size").alias(f"size_{end}")), end, "left").fillna(1, [f"size_{end}"])
    redo = written(redo.select(*pairs.columns, "size_a", "size_b"))
    log = written(early.drop("touched").unionByName(decisions(redo, config.largest_size)))
    touched = written(cut.select("id").unionByName(added.select("id")).unionByName(gone).distinct())
    placed = items.join(touched, "id", "left_semi").select("group", "id")
    now = resolved(placed, log, config).withColumnRenamed("cluster", "first")
    now = written((merged(now) if depth else now).select("group", "id", "first"))
    was = written(old.found.join(touched, "id", "left_semi"))
    found = written(old.found.join(touched, "id", "left_anti").unionByName(now))
    moved = now.join(was.select("id", F.col("first").alias("old")), "id", "full").filter(~F.col("first").eqNullSafe(F.col("old"))).select(F.explode(F.array("first", "old")).alias("first"))
    inside = found.join(added.select("id"), "id", "left_semi").select("first").unionByName(was.join(gone, "id", "left_semi").select("first"))
    affected = written(moved.filter("first is not null").unionByName(inside).distinct())
    again = described(items, found.join(affected, "first", "left_semi"), depth)
    clusters = written(old.clusters.join(affected, "first", "left_anti").unionByName(again.select(*old.clusters.columns)))
    return Level(items, pairs, log, found, clusters), affected, (depth, pairs.count(), redo.count())


def grow(spark: SparkSession, rows: DataFrame, before: Growing | None = None, config: ClusterConfig = ClusterConfig(), gone: DataFrame | None = None, group: str = "namespace", id_col: str = "node_id", content: str | None = "content") -> Growing:
    """The hierarchy after rows are added, and rows with the ids of `gone` removed. Rows with an id that is there replace it. Equal to a build from all rows, whatever the batches."""
    added = written(lowest_items(rows, group, id_col, content))
    levels = list(before.levels) if before else []
    left = added.select("id") if gone is None else added.select("id").unionByName(gone.select(F.col(id_col).cast("string").alias("id")))
    left = written(left.distinct() if levels else left.limit(0))
    work, depth = [], 0
    while True:
        old = levels[depth] if depth < len(levels) else _empty(spark)
        level, affected, done = grow_level(old, added, left, depth, config)
        levels[depth : depth + 1] = [level]
        work.append(done)
        depth += 1
        items = written(next_items(level.clusters))
        if config.most_depth and depth > config.most_depth or items.isEmpty():
            del levels[depth:]
            break
        known = levels[depth].items.select("id") if depth < len(levels) else spark.createDataFrame([], "id string")
        names = affected.select(F.concat(F.lit(f"{depth - 1}:"), F.regexp_replace("first", r"^\d+:", "") if depth > 1 else F.col("first")).alias("id"))
        left = written(known.join(items.select("id"), "id", "left_anti").unionByName(known.join(names, "id", "left_semi")).distinct())
        added = written(items.join(known.join(left, "id", "left_anti"), "id", "left_anti"))
        if left.isEmpty() and added.isEmpty():
            break
    return Growing(levels, work)
