"""Exact vector search: top k for one or many queries, and all pairs above a threshold, by blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.common import partitions, written
from graphloom.functions.vectors import cosine_to, euclidean

#: Queries in a block, and vectors in one of the all-pairs product.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 2048
#: Rows of a group above which deciding_pairs narrows; rows of its blocks at most, the number of blocks of a smaller group, rows of a strip of a block's product, and candidates that are computed at once.
NARROW_ROWS, NARROW_BLOCK, NARROW_BLOCKS, STRIP, HITS = 8192, 16_384, 8, 512, 1 << 16
#: Entries of a batch of a similarity matrix, about.
MATRIX_BATCH = 1 << 17


def top_k(rows: DataFrame, query: list[float], k: int, id_col: str = "node_id", vector: str = "vector", least: float | None = None) -> DataFrame:
    """The k rows most similar to one vector, ties by id; a partial top k on every partition. least filters, inclusive."""
    scored = rows.withColumn("similarity", F.round(cosine_to(F.col(vector), query), 6))
    scored = scored if least is None else scored.filter(F.col("similarity") >= least)
    return scored.orderBy(F.desc("similarity"), id_col).limit(k)


def nearest(rows: DataFrame, query: list[float], k: int, id_col: str = "node_id", vector: str = "vector") -> DataFrame:
    """The k rows at the least Euclidean distance."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("distance", F.round(euclidean(F.col(vector), q), 6)).orderBy("distance", id_col).limit(k)


def _unit(vectors: pa.Array, dimension: int) -> np.ndarray:
    """Rows of unit length; null vectors and those of another dimension are zero, so that their cosine is 0."""
    out = np.zeros((len(vectors), dimension))
    sound = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), dimension), False).to_numpy(zero_copy_only=False))
    if dimension and len(sound):
        own = vectors if len(sound) == len(vectors) else vectors.take(pa.array(sound))
        out[sound] = own.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def top_k_each(rows: DataFrame, queries: DataFrame, k: int | None, id_col: str = "node_id", vector: str = "vector", query_id: str = "query_id", group: str | None = None, least: float = -1.0) -> DataFrame:
    """query_id, id, similarity and rank of the k nearest rows of every query, ties by id; without k, all rows at or above `least`, unranked. With group, a query meets only rows of its own group;
    a query that is given for several groups meets the rows of all of them.

    Rows and queries are dealt into blocks; a block of each is one task's matrix product, and at most k candidates for each query leave it. Neither side goes through the driver. Spark
    keeps the k best of each partition before candidates are shuffled, so a query's candidates aren't gathered either. Null vectors of rows are at similarity 0; rows of another
    dimension than a query's as well.
    """
    kinds, q_kind = dict(rows.dtypes), dict(queries.dtypes)[query_id]
    own = F.col(group) if group else F.lit("")
    left = rows.select(F.col(id_col).alias("id"), own.alias("group"), F.col(vector).alias("vector"))
    right = queries.select(F.col(query_id).alias("query"), own.alias("group"), F.col(vector).alias("vector"))
    blocks = lambda df, size, name: df.groupBy(F.col("group").alias("own")).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = blocks(left, VECTOR_BLOCK, "x").join(blocks(right, QUERY_BLOCK, "y"), "own")  # groups that have both
    deal = lambda df, key, mine, n, other, m: df.join(sizes, F.col("group") == F.col("own")).select(key, "group", "vector", F.pmod(F.xxhash64(key), n).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if a.num_rows and b.num_rows:
            ids = np.array(a.column("id").to_pylist())
            order = np.argsort(ids)  # ties by id: the first of equal scores
            wanted = b.column("vector").combine_chunks()
            lengths = pc.fill_null(pc.list_value_length(wanted), 0).to_numpy(zero_copy_only=False)
            names = b.column("query").to_pylist()
            for dimension in np.unique(lengths).tolist():  # one, as a rule
                at = np.flatnonzero(lengths == dimension)
                unit = _unit(a.column("vector").combine_chunks(), dimension)[order]
                s = np.round(_unit(wanted.take(pa.array(at)), dimension) @ unit.T, 6)
                if k is None:
                    found += [(names[at[i]], ids[order[j]].item(), float(s[i, j])) for i, j in zip(*np.nonzero(s >= least), strict=True)]
                    continue
                many = min(k, s.shape[1])
                last = -np.partition(-s, many - 1, axis=1)[:, many - 1 : many]  # each query's k-th best score
                for i, q in enumerate(at.tolist()):
                    above, same = np.flatnonzero(s[i] > last[i]), np.flatnonzero(s[i] == last[i])
                    for j in [*above.tolist(), *same[: many - len(above)].tolist()]:
                        found.append((names[q], ids[order[j]].item(), float(s[i, j])))
        columns = zip(*found, strict=True) if found else [[], [], []]
        return pa.table([pa.array(x, t) for x, t in zip(columns, [b.schema.field("query").type, a.schema.field("id").type, pa.float64()], strict=True)], ["query", "id", "similarity"])

    keys, n = ["group", "i", "j"], partitions(rows)
    dealt = deal(left, "id", "i", F.col("x"), "j", "y").repartition(n, *keys).groupBy(*keys)
    asked = deal(right, "query", "j", F.col("y"), "i", "x").repartition(n, *keys).groupBy(*keys)
    best = dealt.cogroup(asked).applyInArrow(compare, f"query {q_kind}, id {kinds[id_col]}, similarity double")
    if k is None:
        return best.select(F.col("query").alias(query_id), F.col("id").alias(id_col), "similarity")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("query").alias(query_id), F.col("id").alias(id_col), "similarity", "rank")


def _pairs_of(table: pa.Table, left: np.ndarray, right: np.ndarray, least: float, half: bool, apart: np.ndarray | None = None) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """The smaller and greater id and the similarity of pairs of rows at or above a threshold, one from each side; half: of one side with itself, each pair once; apart: only pairs that differ in this.
    Ids are compared by their places in order and taken by Arrow, so that a block of which all pairs are links makes no objects of them."""
    ids = table.column("id").combine_chunks()
    place = np.unique(np.array(ids.to_pylist()), return_inverse=True)[1].astype(np.int32)
    dimension = pc.max(pc.list_value_length(table.column("vector"))).as_py() or 0
    unit = _unit(table.column("vector").combine_chunks(), dimension)
    s = unit[left] @ unit[right].T
    np.round(s, 6, out=s)
    hit = s >= least
    if half:
        hit &= place[left][:, None] < place[right][None, :]
    if apart is not None:
        hit &= apart[left][:, None] != apart[right][None, :]
    at = np.flatnonzero(hit)
    similarity = s.ravel()[at]
    del s, hit
    x, y = left[at // max(len(right), 1)].astype(np.int32), right[at % max(len(right), 1)].astype(np.int32)
    del at
    swap = place[x] > place[y]
    low, high = np.where(swap, y, x), np.where(swap, x, y)
    return ids.take(pa.array(low)), ids.take(pa.array(high)), similarity


def similar_pairs(rows: DataFrame, least: float, group: str | None = None, id_col: str = "node_id", vector: str = "vector") -> DataFrame:
    """a, b and similarity of all pairs a < b at or above a threshold, within groups if given; null vectors are in none.

    Rows are dealt into blocks of about VECTOR_BLOCK; each pair of blocks is one task's matrix product and only its links leave it. Work grows
    with the square of the rows, as an exact all-pairs product must; memory does not.
    """
    own = F.col(group) if group else F.lit("")
    base = rows.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), own.alias("group"), F.col(vector).alias("vector"))
    blocks = base.groupBy(F.col("group").alias("own")).agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("blocks"))
    placed = base.join(blocks, F.col("group").eqNullSafe(F.col("own"))).select("id", "group", "vector", "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("mine"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "group", "vector", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    kind = dict(rows.dtypes)[id_col]

    def compare(table: pa.Table) -> pa.Table:
        mine, i, j = table.column("mine").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        a, b, s = _pairs_of(table, np.flatnonzero(mine == i), np.flatnonzero(mine == j), least, i == j)
        return pa.table({"a": a, "b": b, "group": pa.repeat(pa.scalar(table.column("group")[0].as_py(), pa.string()), len(a)), "similarity": pa.array(s)})

    return dealt.repartition(partitions(rows), "group", "i", "j").groupBy("group", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}, `group` string, similarity double")


class _Product:
    """A task's product of vectors: its ids in order, of each the row that it comes from, and its pairs. Rows come on the left, on the right, or both; of a right row that is `once`, only pairs with smaller ids count."""

    def __init__(self, table: pa.Table, least: float):
        ids, vectors = table.column("id").combine_chunks(), table.column("vector").combine_chunks()
        named = np.array(ids.to_pylist())
        order = np.argsort(named, kind="stable")
        first = np.append(True, named[order][1:] != named[order][:-1])
        place, side = np.cumsum(first) - 1, lambda name: table.column(name).to_numpy()[order]
        self.least, self.rows, self.names = least, order[first], named[order][first]
        self.ids, self.left, self.right, self.once = ids.take(pa.array(self.rows)), place[side("left")], place[side("right")], side("once")[side("right")]
        self.dimension = pc.max(pc.list_value_length(vectors)).as_py() or 0
        self.unit = _unit(vectors, self.dimension)[self.rows]

    def of(self, table: pa.Table, column: str) -> np.ndarray:
        """A number of each id, null as less than all."""
        return pc.fill_null(table.column(column), -np.inf).to_numpy()[self.rows]

    def pairs(self, bound: np.ndarray, greater: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of the smaller and the greater id of pairs at or above the threshold, with their similarity, by strips. Most that are below the bound of their smaller id, or their greater one, are left out;
        bounds may rise meanwhile. A product in 32 bits finds the candidates, with more slack than it can err; their similarity is computed in 64 bits, the same in every product."""
        low, slack = self.unit.astype(np.float32), 1e-5 + 2e-7 * self.dimension
        across, right = np.ascontiguousarray(low[self.right].T), self.right
        for k in range(0, len(self.left), STRIP):
            own = self.left[k : k + STRIP]
            begin, end = np.searchsorted(right, own[0]), np.searchsorted(right, own[-1], "right")
            for at, to in ((0, begin), (begin, end), (end, len(right))):  # ids on the right are smaller, mixed, greater
                if at == to or to == begin and self.once[at:to].all():
                    continue
                floor = np.float32(self.least - slack)
                if at == end or to == begin:
                    by_right = greater == (at == end)
                    floor = (np.maximum(bound[right[at:to] if by_right else own], self.least) - slack).astype(np.float32)
                    floor = floor[None, :] if by_right else floor[:, None]
                hits = np.flatnonzero(low[own] @ across[:, at:to] >= floor)
                for h in range(0, len(hits), HITS):
                    i, j = np.divmod(hits[h : h + HITS], to - at)
                    x, y, once = own[i], right[at + j], self.once[at + j]
                    kept = (x < y) | (x > y) & ~once
                    x, y = x[kept], y[kept]
                    s = np.round(np.einsum("ij,ij->i", self.unit[x], self.unit[y]), 6)
                    kept = s >= self.least
                    yield np.minimum(x, y)[kept], np.maximum(x, y)[kept], s[kept]


def _blocks_of(counts: Column) -> Column:
    return F.greatest(F.ceil(counts / NARROW_BLOCK), F.least(F.ceil(counts / VECTOR_BLOCK), F.lit(NARROW_BLOCKS))).cast("int")


def _blocked(base: DataFrame) -> DataFrame:
    """Rows (id, group, vector) with the number of blocks of their group, and their own; written."""
    blocks = base.groupBy(F.col("group").alias("own")).agg(_blocks_of(F.count("*")).alias("blocks"))
    base = base.join(blocks, F.col("group").eqNullSafe(F.col("own")))
    return written(base.select("id", "group", "vector", "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("mine")))


def _products(base: DataFrame, compare, made: str, asked: DataFrame | None = None) -> DataFrame:
    """compare() for all pairs of blocks; with asked (id), for pairs of a block of those rows with every block of all, so that each pair with such a row is in one."""
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    if asked is None:
        dealt = base.withColumn("other", every(F.col("blocks"))).withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
        dealt = dealt.withColumns({"left": F.col("mine") == F.col("i"), "right": F.col("mine") == F.col("j"), "once": F.col("i") == F.col("j")}).drop("other", "blocks", "mine")
    else:
        base = base.join(asked.select("id", F.lit(True).alias("once")), "id", "left").withColumn("once", F.coalesce("once", F.lit(False)))
        sizes = base.filter("once").groupBy(F.col("group").alias("own")).agg(_blocks_of(F.count("*")).alias("many"))
        base = base.join(sizes, F.col("group").eqNullSafe(F.col("own"))).drop("own")
        left = base.filter("once").withColumn("i", F.pmod(F.xxhash64("id"), "many").cast("int")).withColumn("j", every(F.col("blocks"))).withColumns({"left": F.lit(True), "right": F.lit(False)})
        right = base.withColumn("j", F.col("mine")).withColumn("i", every(F.col("many"))).withColumns({"left": F.lit(False), "right": F.lit(True)})
        dealt = left.unionByName(right).drop("blocks", "mine", "many")
    return dealt.repartition(partitions(base), "group", "i", "j").groupBy("group", "i", "j").applyInArrow(compare, made)


def _nearest_before(base: DataFrame, least: float, asked: DataFrame | None = None) -> DataFrame:
    """id and low: the greatest similarity of each row to one of smaller id."""

    def compare(table: pa.Table) -> pa.Table:
        product = _Product(table, least)
        best = np.full(len(product.ids), -np.inf)
        for _, b, s in product.pairs(best, True):
            np.maximum.at(best, b, s)
        at = np.flatnonzero(best > -np.inf)
        return pa.table({"id": product.ids.take(pa.array(at)), "low": pa.array(best[at])})

    return _products(base, compare, f"id {dict(base.dtypes)['id']}, low double", asked).groupBy("id").agg(F.max("low").alias("low"))


def _first_sure(base: DataFrame, least: float, asked: DataFrame | None = None) -> DataFrame:
    """id, rank (the similarity, negative) and sure: each row's first pair whose smaller id, sure, is surely there. Rows bring their `low`."""

    def compare(table: pa.Table) -> pa.Table:
        product = _Product(table, least)
        low, n = product.of(table, "low"), len(product.ids)
        best, first = np.full(n, -np.inf), np.full(n, n)
        for a, b, s in product.pairs(low, False):
            sure = s > low[a]  # a pair of equal similarity that takes a has a smaller first end, so it is before
            a, b, s = a[sure], b[sure], s[sure]
            before = best.copy()
            np.maximum.at(best, b, s)
            first[best > before] = n
            same = s == best[b]
            np.minimum.at(first, b[same], a[same])
        at = np.flatnonzero(best > -np.inf)
        return pa.table({"id": product.ids.take(pa.array(at)), "rank": pa.array(-best[at]), "sure": product.ids.take(pa.array(first[at]))})

    kind = dict(base.dtypes)["id"]
    return _earliest(_products(base, compare, f"id {kind}, rank double, sure {kind}", asked))


def _earliest(sure: DataFrame) -> DataFrame:
    return sure.groupBy("id").agg(F.min(F.struct("rank", "sure")).alias("l")).select("id", "l.rank", "l.sure")


def _up_to(base: DataFrame, least: float, asked: DataFrame | None = None) -> DataFrame:
    """a, b, group and similarity of each row's pairs up to the one that `rank` and `sure` name, all where they are null."""

    def compare(table: pa.Table) -> pa.Table:
        product = _Product(table, least)
        last = product.of(table, "last")
        sure = table.column("sure").combine_chunks().take(pa.array(product.rows))
        known = np.flatnonzero(~sure.is_null().to_numpy(zero_copy_only=False))
        many = np.zeros(len(product.ids), np.int64)  # ids up to the first end of the last pair
        if len(known):
            many[known] = np.searchsorted(product.names, np.array(sure.take(pa.array(known)).to_pylist()), "right")
        out = []
        for a, b, s in product.pairs(last, True):
            kept = (s > last[b]) | ((s == last[b]) & (a < many[b]))
            out.append((a[kept], b[kept], s[kept]))
        a, b, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        own = pa.repeat(pa.scalar(table.column("group")[0].as_py(), pa.string()), len(a))
        return pa.table({"a": product.ids.take(pa.array(a)), "b": product.ids.take(pa.array(b)), "group": own, "similarity": pa.array(s)})

    kind = dict(base.dtypes)["id"]
    return _products(base.withColumn("last", -F.col("rank")).drop("rank"), compare, f"a {kind}, b {kind}, `group` string, similarity double", asked)


def linked(rows: DataFrame, least: float, group: str | None = None, id_col: str = "node_id", vector: str = "vector") -> DataFrame:
    """id of each row that is in a pair of similar_pairs(), once; the pairs themselves don't leave their tasks."""
    own = F.col(group) if group else F.lit("")
    base = _blocked(rows.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), own.alias("group"), F.col(vector).alias("vector")))

    def compare(table: pa.Table) -> pa.Table:
        product = _Product(table, least)
        seen, none = np.zeros(len(product.ids), bool), np.full(len(product.ids), -np.inf)
        for a, b, _ in product.pairs(none, True):
            seen[a] = seen[b] = True
        return pa.table({"id": product.ids.take(pa.array(np.flatnonzero(seen)))})

    return _products(base, compare, f"id {dict(base.dtypes)['id']}").distinct()


def largest_group(rows: DataFrame, group: str = "group", vector: str = "vector") -> int:
    """Rows with a vector of the group that has most."""
    return rows.filter(F.col(vector).isNotNull()).groupBy(group).count().agg(F.max("count")).first()[0] or 0


def deciding_pairs(rows: DataFrame, least: float, group: str | None = None, id_col: str = "node_id", vector: str = "vector") -> DataFrame:
    """a, b, group and similarity of the pairs of similar_pairs() that can decide by which one a cluster goes (see operators.cluster), about two for each row; of all pairs where no group has more than NARROW_ROWS.

    b goes by its first pair whose a is there still, and a is there surely before the first pair by which it could go itself. So three products of all blocks, of which none leaves more than it says: first the
    greatest similarity of each row to one of smaller id, then each row's first pair whose a is surely there, last the pairs up to that. Links grow with the square of the rows; they are never written.
    """
    own = F.col(group) if group else F.lit("")
    base = rows.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), own.alias("group"), F.col(vector).alias("vector"))
    if largest_group(base) <= NARROW_ROWS:
        return similar_pairs(base, least, "group", "id")
    base = _blocked(base)
    base = written(base.join(_nearest_before(base, least), "id", "left"))
    base = written(base.join(_first_sure(base, least), "id", "left").drop("low"))
    return _up_to(base, least)


def more_deciding_pairs(rows: DataFrame, added: DataFrame, before: DataFrame, kept: DataFrame, least: float) -> DataFrame:
    """a, b, group and similarity of pairs that, with those kept, have what deciding_pairs() has of all rows (id, group, vector), after some (added: id) came. before: pairs that it had of rows that are there
    still as the greater id, kept: those of them of which both are. Products are of the added rows, and of the others whose last pair isn't sure any more, with all.

    A row's first pair is among its pairs, so they say how near it is to smaller ids; where that pair is lost, it was nearer than it is, which only keeps more pairs.
    A row's pairs are all up to its last, between which what was added is filled in; where none of them is sure any more, a surer one that was added later doesn't do, as old pairs before that aren't there.
    """
    base = _blocked(rows.filter("vector is not null").select("id", "group", "vector"))
    near = before.select(F.col("b").alias("id"), F.col("similarity").alias("low")).unionByName(_nearest_before(base, least, added))
    low = written(near.groupBy("id").agg(F.max("low").alias("low")))
    base = written(base.join(low, "id", "left"))
    held = kept.join(low.withColumnRenamed("id", "a"), "a", "left").filter("low is null or similarity > low").select(F.col("b").alias("id"), (-F.col("similarity")).alias("rank"), F.col("a").alias("sure"))
    first = _earliest(held.unionByName(_first_sure(base, least, added))).select("id", F.struct("rank", "sure").alias("first"))
    far = before.groupBy(F.col("b").alias("id")).agg(F.max(F.struct((-F.col("similarity")).alias("rank"), F.col("a").alias("sure"))).alias("far"))
    told = written(far.join(first, "id", "full"))
    stale = written(told.filter("far is not null and (first is null or first > far)").select("id").join(added, "id", "left_anti"))
    known = told.join(stale, "id", "left_anti").select("id", F.coalesce("far", "first").alias("l")).select("id", "l.rank", "l.sure")
    last = known.unionByName(_first_sure(base, least, stale).join(stale, "id", "left_semi"))
    base = written(base.drop("low").join(last, "id", "left"))
    return _up_to(base, least, added.select("id").unionByName(stale))


def similar_across(rows: DataFrame, least: float, group: str = "namespace", id_col: str = "node_id", vector: str = "vector") -> DataFrame:
    """a, b and similarity of all pairs a < b of rows of different groups at or above a threshold. Null vectors and groups are in none. Rows are dealt into blocks by a hash of their ids, whatever their group, and
    each row goes to the products of its block with every other; pairs within a group are masked there."""
    base = rows.filter(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(F.col(id_col).alias("id"), F.col(group).alias("group"), F.col(vector).alias("vector"))
    blocks = max(1, -(-base.count() // VECTOR_BLOCK))
    mine = base.withColumn("mine", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "group", "vector", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    kind = dict(rows.dtypes)[id_col]

    def compare(table: pa.Table) -> pa.Table:
        own, i, j = table.column("mine").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        groups = table.column("group").combine_chunks().dictionary_encode().indices.to_numpy()
        a, b, s = _pairs_of(table, np.flatnonzero(own == i), np.flatnonzero(own == j), least, i == j, groups)
        return pa.table({"a": a, "b": b, "similarity": pa.array(s)})

    return dealt.repartition(partitions(rows), "i", "j").groupBy("i", "j").applyInArrow(compare, f"a {kind}, b {kind}, similarity double")


def similarity_matrix(rows: DataFrame, group: str | None = None, id_col: str = "node_id", vector: str = "vector", least: float = -1.0) -> DataFrame:
    """a, b, group and similarity of the whole matrix of a group: both halves, and 1 on the diagonal. As large as the square of the rows, which leaves the tasks by strips of a product and is shuffled nowhere;
    what is shuffled are vectors, once for each block of NARROW_BLOCK rows or fewer."""
    own = F.col(group) if group else F.lit("")
    base = _blocked(rows.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), own.alias("group"), F.col(vector).alias("vector")))
    dealt = base.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "group", "vector", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    dealt = dealt.repartition(max(partitions(base), NARROW_BLOCKS * NARROW_BLOCKS), "group", "i", "j").sortWithinPartitions("group", "i", "j")
    kind = dict(rows.dtypes)[id_col]

    def tell(name: str | None, i: int, j: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, vectors, mine = (table.column(c).combine_chunks() for c in ("id", "vector", "mine"))
        unit, mine = _unit(vectors, pc.max(pc.list_value_length(vectors)).as_py() or 0), mine.to_numpy()
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)

        def batch(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": ids.take(pa.array(x)), "b": ids.take(pa.array(y)), "group": pa.repeat(pa.scalar(name, pa.string()), len(x)), "similarity": pa.array(s)})

        strip = max(1, MATRIX_BATCH // max(1, len(right)))
        for k in range(0, len(left), strip):
            x = left[k : k + strip]
            s = np.round(unit[x] @ unit[right].T, 6)
            hit = s >= least
            if i == j:
                hit &= x[:, None] < right[None, :]
                yield batch(x, x, np.ones(len(x)))
            at, to = np.nonzero(hit)
            yield batch(x[at], right[to], s[at, to])
            yield batch(right[to], x[at], s[at, to])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for rows_ in batches:
            keys = list(zip(*(rows_.column(c).to_pylist() for c in ("group", "i", "j")), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin < end and keys[begin] != last:
                    if parts:
                        yield from tell(*last, pa.Table.from_batches(parts))
                    last, parts = keys[begin], []
                parts.append(rows_.slice(begin, end - begin))
        if parts:
            yield from tell(*last, pa.Table.from_batches(parts))

    return dealt.mapInArrow(run, f"a {kind}, b {kind}, `group` string, similarity double")


def similarity_edges(rows: DataFrame, least: float = 0.5, group: str = "namespace", id_col: str = "node_id") -> DataFrame:
    """Semantic edges of all pairs within a group: weight 1 / similarity, confidence 0.8."""
    pairs = similar_pairs(rows, least, group, id_col)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("group").alias(group), F.lit("semantic").alias("edge_type"), F.round(1 / F.col("similarity"), 6).alias("weight"), "similarity", F.lit(0.8).alias("confidence"))


def centroids(rows: DataFrame, by: str | list[str], vector: str = "vector") -> DataFrame:
    """The mean vector of each group, not normalised; null where a group's dimensions differ or are 0. Components are averaged map-side."""
    keys = [by] if isinstance(by, str) else by
    sizes = rows.groupBy(*keys).agg(F.min(F.size(vector)).alias("_low"), F.max(F.size(vector)).alias("_high"), F.count("*").alias("members"))
    parts = rows.select(*keys, F.posexplode(vector).alias("place", "x")).groupBy(*keys, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("centroid"))
    return sizes.join(means, keys, "left").select(*keys, "members", F.when((F.col("_low") == F.col("_high")) & (F.col("_low") > 0), F.col("centroid")).alias("centroid"))


def average_pairwise(rows: DataFrame, by: str, id_col: str = "node_id", vector: str = "vector") -> DataFrame:
    """The mean cosine of all pairs of each group; 1 for groups of one. The sum of all pairs follows from the sum of the unit vectors: (|sum|^2 - sum of |v|^2) / 2, so no pair is made."""
    from graphloom.functions.vectors import norm

    unit = rows.filter(F.col(vector).isNotNull()).withColumn("_n", norm(F.col(vector)))
    flat = unit.select(by, (F.col("_n") > 0).cast("long").alias("one"), F.posexplode(vector).alias("place", "x"), "_n").withColumn("x", F.when(F.col("_n") > 0, F.col("x").cast("double") / F.col("_n")).otherwise(0.0))
    sums = flat.groupBy(by, "place").agg(F.sum("x").alias("x")).groupBy(by).agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    counts = unit.groupBy(by).agg(F.count("*").alias("n"), F.sum((F.col("_n") > 0).cast("long")).alias("ones"))
    n = F.col("n")
    mean: Column = (F.col("square") - F.col("ones")) / (n * (n - 1))
    return counts.join(sums, by).select(by, n.alias("members"), F.when(n < 2, 1.0).otherwise(mean).alias("average_similarity"))
