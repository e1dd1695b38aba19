"""N-gram Jaccard self-join of documents by chosen paths.

A document is its set of distinct word shingles; equal sets count as one. A set is embedded by MinHash coordinates: set and coordinate's value are its tokens, and two sets
share a token with the probability of their Jaccard similarity. Each run walks down a tree that all sets share: a node samples a coordinate,
and a set goes to the child of its token, so that after `depth` steps those together share all the chosen tokens. Runs are repeated until a
pair at the threshold meets in one with the target recall.

Sets of a bucket are linked to its least and greatest one where their sketches allow it, which gathers most of what is similar into components. Buckets that hold one component
then need no more. Of the others, those that are small are compared by brute force: the sketches of all sets of different components, block by block, so meeting in a bucket is enough.
Large ones are split: each of their sets walks on for `depth` more steps, in as many runs within the bucket as the target recall asks for, until buckets are small. Within a
component all pairs are compared exactly, block by block, by a product of incidence matrices; only counts and spanning links leave a block, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import U64, distinct_per_row, materialize, mix, row_key, shingles, slices, word_hashes
from graphloom.llm.graph import components

#: MinHash coordinates, steps of a path, and the wanted chance that a pair at the threshold meets in a bucket. A sketch is a byte of each coordinate.
COORDINATES, DEPTH, RECALL = 128, 6, 1 - 1e-6
#: Sets in a block of exact comparison, and tokens in a slab of its matrix.
BLOCK_SETS, SLAB = 512, 4096
#: A bucket is small up to the pairs of so many sets: comparing their sketches takes less time there than walking on in all runs does. Splits at most, after which blocks are compared whatever their number.
SMALL_SETS, MOST_SPLITS = 32_768, 6
#: Standard errors below the threshold at which a sketch still counts as similar.
SKETCH_ERRORS = 5


def runs_for(threshold: float, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Runs after which a pair has met with that chance. All runs draw from the same coordinates, of which a binomial number agrees."""
    agree = [math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) for k in range(COORDINATES + 1)]
    miss = lambda runs: math.fsum(p * (1 - (k / COORDINATES) ** depth) ** runs for k, p in enumerate(agree))
    runs = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**depth)))
    while miss(runs) > 1 - recall:
        runs += 1
    return runs


def coordinates(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each set; sets aren't empty."""
    rng = np.random.default_rng(3)
    a = rng.integers(1, 2**63, COORDINATES, dtype=U64) * U64(2) + U64(1)
    b = rng.integers(0, 2**63, COORDINATES, dtype=U64)
    out = np.empty((len(starts) - 1, COORDINATES), U64)
    for k in range(COORDINATES):
        x = tokens * a[k] + b[k]
        out[:, k] = np.minimum.reduceat(x ^ (x >> U64(29)), starts[:-1])
    return out


def paths(values: np.ndarray, runs: int, depth: int = DEPTH, begin: np.ndarray | None = None) -> np.ndarray:
    """The node that each set reaches in each run, from the root or a node of its own; the coordinate that a node samples follows from the node alone."""
    rows = np.arange(len(values))
    out = np.empty((len(values), runs), U64)
    for run in range(runs):
        node = np.full(len(values), run + 1, U64) if begin is None else mix(begin + U64(run + 1))
        for _ in range(depth):
            node = mix(node)
            node = node * U64(0x9E3779B97F4A7C15) + values[rows, (node % U64(COORDINATES)).astype(np.int64)]
        out[:, run] = mix(node)
    return out


def signatures(rows: DataFrame, threshold: float) -> DataFrame:
    """doc_id, k1, k2, the set's key s, its number of shingles, sketch and paths of each row; rows without words have key 0, no sketch and no paths."""
    runs = runs_for(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x, starts = distinct_per_row(*shingles(*word_hashes(part.column("text"))))
                size = np.diff(starts)
                full = np.flatnonzero(size)
                key = np.zeros(part.num_rows, U64)
                sketch, path = [None] * part.num_rows, [None] * part.num_rows
                if len(full):
                    begins = starts[:-1][full]
                    key[full] = mix(np.add.reduceat(mix(x), begins) + size[full].astype(U64)) | U64(1)
                    values = coordinates(x, np.append(begins, len(x)))
                    reached = paths(values, runs).view(np.int64)
                    small = (values & U64(0xFF)).astype(np.uint8)
                    for k, at in enumerate(full.tolist()):
                        sketch[at], path[at] = small[k].tobytes(), reached[k]
                own = [part.column(c) for c in ("doc_id", "k1", "k2")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(key.view(np.int64)), pa.array(size.astype(np.int64)), pa.array(sketch, pa.binary()), pa.array(path, pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "s", "n", "sketch", "paths"])

    kind = dict(rows.dtypes)["doc_id"]
    return materialize(rows.select("doc_id", "text", "k1", "k2").mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, s long, n long, sketch binary, paths array<long>"), "lz4")


def similar_sketches(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of which at least that share of the sketches' coordinates agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("x", "y"))
            keep = pa.array((x == y).mean(1) >= least) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def spanning_pairs(sketch: np.ndarray, comp: np.ndarray, left: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of components that join all those of which two sets' sketches agree by at least that share: sets of the first `left` with the others, or all if left is 0."""
    x, y = (sketch[:left], sketch[left:]) if left else (sketch, sketch)
    agree = np.zeros((len(x), len(y)), np.uint8)
    for k in range(COORDINATES):
        agree += x[:, k, None] == y[None, :, k]
    i, j = np.nonzero(agree >= least * COORDINATES)
    kinds, of = np.unique(comp, return_inverse=True)
    i, j = of[i], of[j + left]
    i, j = np.divmod(np.unique((np.minimum(i, j) * len(kinds) + np.maximum(i, j))[i != j]), len(kinds))
    root = np.arange(len(kinds))
    while len(i):
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (before == root).all():
            break
    child = np.flatnonzero(root != np.arange(len(kinds)))
    return kinds[child], kinds[root[child]]


def compare_sketches(groups: DataFrame, least: float) -> DataFrame:
    """groups: path, pair, side, comp, sketch. Links (a, b) of components, see spanning_pairs: between sides 0 and 1 of a (path, pair), or within the side if it has one.
    A group is one task's, and holds two blocks at most."""
    dealt = groups.repartition("path", "pair").sortWithinPartitions("path", "pair", "side")

    def links(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        """Links of all groups that are complete, and the rows of the one that isn't."""
        path, pair, side, comp = (table.column(c).to_numpy() for c in ("path", "pair", "side", "comp"))
        begins = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (pair[1:] != pair[:-1]))))
        ends = np.append(begins[1:], table.num_rows)
        done = table.num_rows if last else int(begins[-1])
        sketch = np.frombuffer(b"".join(table.column("sketch").slice(0, done).to_pylist()), np.uint8).reshape(-1, COORDINATES)
        found = [np.zeros((2, 0), np.int64)]
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            left = int(np.searchsorted(side[a:b], 1)) % (b - a)  # 0 with one side
            if b <= done:
                found.append(np.stack(spanning_pairs(sketch[a:b], comp[a:b], left, least)))
        out = np.concatenate(found, 1)
        return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], ["a", "b"]), table.slice(done)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            if held.num_rows:
                out, held = links(held, False)
                yield out
        if held is not None and held.num_rows:
            yield links(held, True)[0]

    return dealt.select("path", "pair", "side", "comp", "sketch").mapInArrow(run, "a long, b long")


def walked_on(rows: DataFrame, sketches: DataFrame, runs: int) -> DataFrame:
    """path, s and comp of the buckets below those of rows (path, s, comp): as many runs as given, each from the old bucket on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                values = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES).astype(U64)
                s, comp = (np.repeat(batch.column(c).to_numpy(), runs) for c in ("s", "comp"))
                reached = paths(values, runs, begin=batch.column("path").to_numpy().view(U64))
                yield pa.RecordBatch.from_arrays([pa.array(reached.ravel().view(np.int64)), pa.array(s), pa.array(comp)], ["path", "s", "comp"])

    return rows.select("path", "s", "comp").join(sketches.select("s", "sketch"), "s").mapInArrow(run, "path long, s long, comp long")


def bucket_links(held: DataFrame, gathered: DataFrame, sketches: DataFrame, least: float, runs: int) -> DataFrame:
    """Links (a, b) between components of gathered (v, root) that meet in a bucket of held (path, s), as far as their sets' sketches agree.

    A component of more than BLOCK_SETS sets of a bucket needn't be compared with itself there. A bucket whose other pairs are more than those of SMALL_SETS sets is split.
    A smaller one of at most BLOCK_SETS sets is one group; else it is cut into blocks: such a component has blocks of its own, the remaining sets share blocks; each pair of blocks is a group."""
    rows = materialize(held.join(gathered.withColumnRenamed("v", "s"), "s", "left").select("path", "s", F.coalesce("root", "s").alias("comp")), "lz4")
    found = []
    for level in range(MOST_SPLITS + 1):
        kinds = rows.groupBy("path", "comp").agg(F.count("*").alias("c"))
        own = F.sum(F.when(F.col("c") > BLOCK_SETS, F.col("c").cast("double") * F.col("c")).otherwise(0.0))
        sizes = kinds.groupBy("path").agg(F.sum("c").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), own.alias("own"))
        large = (F.col("n").cast("double") * F.col("n") - F.col("own") > float(SMALL_SETS) ** 2) & F.lit(level < MOST_SPLITS)
        mixed = sizes.filter("low != high" + " and n > 2" * (level == 0)).select("path", "n", large.alias("large"))  # two sets are their bucket's ends
        rows = materialize(rows.join(materialize(mixed, "lz4"), "path"), "lz4")
        found.append(rows.filter("not large").drop("large"))
        if level == MOST_SPLITS or rows.filter("large").isEmpty():
            break
        rows = materialize(walked_on(rows.filter("large"), sketches, runs), "lz4")
    rows = reduce(DataFrame.unionByName, found)
    whole = rows.filter(F.col("n") <= BLOCK_SETS).select("path", F.lit(0).cast("long").alias("pair"), F.lit(0).alias("side"), "s", "comp")

    large = rows.filter(F.col("n") > BLOCK_SETS)
    kinds = large.groupBy("path", "comp").agg(F.count("*").alias("c")).withColumn("own", F.when(F.col("c") > BLOCK_SETS, F.col("comp")).otherwise(F.lit(0)))
    kinds = materialize(kinds, "lz4")  # keys of sets are odd, so 0 is no component
    number = materialize(kinds.groupBy("path", "own").agg(F.ceil(F.sum("c") / BLOCK_SETS).cast("int").alias("blocks")), "lz4")
    blocks = number.select("path", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    first, second = F.struct("own", "block"), F.struct(F.col("own2").alias("own"), F.col("block2").alias("block"))
    both = blocks.join(blocks.select("path", F.col("own").alias("own2"), F.col("block").alias("block2")), "path").filter((first <= second) & ((F.col("own") != F.col("own2")) | (F.col("own") == 0)))
    both = both.select("path", F.array(first, second).alias("of"), F.xxhash64(first, second).alias("pair"))
    sides = materialize(both.select("path", "pair", F.posexplode(F.array_distinct("of")).alias("side", "at")).select("path", "pair", "side", "at.own", "at.block"), "lz4")
    placed = large.select("path", "s", "comp").join(kinds.select("path", "comp", "own"), ["path", "comp"]).join(number, ["path", "own"]).withColumn("block", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int"))
    cut = placed.join(sides, ["path", "own", "block"]).select("path", "pair", "side", "s", "comp")
    return compare_sketches(whole.unionByName(cut).join(sketches.select("s", "sketch"), "s"), least)


def exact_links(sizes: np.ndarray, tokens: np.ndarray, left: int, threshold: float) -> np.ndarray:
    """Which sets, given one after another, reach the threshold: the first `left` by the others, or all by all if left is 0."""
    m = len(sizes)
    kinds, of, count = np.unique(tokens, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(m), sizes)
    shared = count[of] > 1
    row, column = row[shared], place[of[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    a, b = (slice(0, left), slice(left, m)) if left else (slice(0, m), slice(0, m))
    both = np.zeros((len(range(*a.indices(m))), len(range(*b.indices(m)))), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, SLAB):
        p = slice(*np.searchsorted(column, [at, at + SLAB]))
        grid = np.zeros((m, min(SLAB, width - at)), np.float32)
        grid[row[p], column[p] - at] = 1
        both += grid[a] @ grid[b].T
    t = Fraction(threshold).limit_denominator(1000)
    union = sizes[a][:, None] + sizes[b][None, :] - both
    return both * t.denominator >= union * t.numerator


def compare_blocks(sets: DataFrame, threshold: float) -> DataFrame:
    """sets: comp, i, j (blocks compared), mine (the block of the row), s, m (rows with this set), tokens. Returns for each row s, root (the least set it is linked to in this
    comparison, directly or not) and links (rows of other sets it is linked to). Each comparison is one task's, and holds two blocks at most."""
    dealt = sets.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "mine", "s")

    def finish(held: list[tuple]) -> pa.RecordBatch:
        _, i, j, _, _, _, _ = held[0]
        s, m = np.array([x[4] for x in held]), np.array([x[5] for x in held], np.int64)
        sizes = np.array([len(x[6]) // 8 for x in held], np.int64)
        left = 0 if i == j else sum(x[3] == i for x in held)
        n = len(held)
        linked = np.zeros((n, n), bool)
        found = exact_links(sizes, np.frombuffer(b"".join(x[6] for x in held), np.int64), left, threshold) if i == j or 0 < left < n else None
        if found is not None and i == j:
            linked[:] = found
            np.fill_diagonal(linked, False)
        elif found is not None:
            linked[:left, left:] = found
            linked[left:, :left] = found.T
        links = linked @ m
        np.fill_diagonal(linked, True)
        root = s.copy()
        while True:
            least = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1)
            if (least == root).all():
                break
            root = least
        return pa.RecordBatch.from_arrays([pa.array(s), pa.array(root), pa.array(links)], ["s", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("comp", "i", "j", "mine", "s", "m", "tokens")), strict=True):
                if held and x[:3] != held[0][:3]:
                    yield finish(held)
                    held = []
                if not held or (x[3], x[4]) != (held[-1][3], held[-1][4]):
                    held.append(x)
        if held:
            yield finish(held)

    return dealt.select("comp", "i", "j", "mine", "s", "m", "tokens").mapInArrow(run, "s long, root long, links long")


def with_tokens(reps: DataFrame, rows: DataFrame) -> DataFrame:
    """reps' columns and `tokens`, the shingles of each set, made again from one document that has it."""
    joined = rows.select("text", "k1", "k2").join(reps, ["k1", "k2"]).select("text", *(c for c in reps.columns if c not in ("k1", "k2")))
    schema = ", ".join(f"{n} {k}" for n, k in joined.dtypes if n != "text") + ", tokens binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x, starts = distinct_per_row(*shingles(*word_hashes(part.column("text"))))
                tokens = [x[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(tokens, pa.binary())], [*part.schema.names[1:], "tokens"])

    return joined.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row for each row of docs: doc_id, k1, k2 (see row_key), class_id, n_links and kept.

    Rows are linked if their sets of five-word shingles have a Jaccard similarity of at least threshold; texts of one to four words are one
    shingle. n_links counts the other rows a row is linked to, class_id is the least doc_id of the rows connected by links, and kept marks one row of each class, the
    one with least id (nulls last); repeated rows with equal id and text are kept or not together. Rows without words (null, empty) are copies of
    each other. An empty table gives an empty result. Sets are told apart by 64-bit keys.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), *row_key(id_col, text))
    sig = signatures(rows, threshold)
    sets = materialize(sig.groupBy("s").agg(F.count("*").alias("m"), F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "k1", "k2")).alias("first")), "lz4")

    reached = sig.select("s", F.explode("paths").alias("path"))
    buckets = materialize(reached.groupBy("path").agg(F.min("s").alias("low"), F.max("s").alias("high")).filter("low != high"), "lz4")
    held = materialize(reached.join(buckets, "path").distinct(), "lz4")
    ends = F.explode(F.array("low", "high")).alias("b")
    pairs = materialize(held.select(F.col("s").alias("a"), ends).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "lz4")

    members = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "s")
    sketches = materialize(sig.select("s", "n", "sketch").join(materialize(members, "lz4"), "s").dropDuplicates(["s"]), "lz4")
    x, y = sketches.select(F.col("s").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x")), sketches.select(F.col("s").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    least = threshold - SKETCH_ERRORS * math.sqrt(threshold * (1 - threshold) / COORDINATES)
    gathered = materialize(components(similar_sketches(pairs.join(x, "a").join(y, "b"), least)), "lz4")
    more = bucket_links(held.select("path", "s"), gathered, sketches, least, runs_for(threshold))
    gathered = components(gathered.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(more))

    placed = gathered.select(F.col("v").alias("s"), F.col("root").alias("comp")).unionByName(gathered.select(F.col("root").alias("s"), F.col("root").alias("comp")).distinct())
    placed = materialize(placed, "lz4")
    blocks = placed.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks"))
    reps = placed.join(materialize(blocks, "lz4"), "comp").join(sets, "s").select("comp", "s", "m", "first.k1", "first.k2", "blocks", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int").alias("mine"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tokens = with_tokens(reps, rows).select("*", others).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    compared = materialize(compare_blocks(tokens, threshold), "lz4")
    classes = components(compared.select(F.col("s").alias("a"), F.col("root").alias("b")))
    links = compared.groupBy("s").agg(F.sum("links").alias("links"))

    placed = sets.join(classes.withColumnRenamed("v", "s"), "s", "left").join(links, "s", "left").select("s", "m", "first", F.coalesce("root", "s").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    placed = materialize(placed, "lz4")
    heads = materialize(placed.groupBy("root").agg(F.min("first").alias("head")), "lz4")
    verdicts = materialize(placed.join(heads, "root").select("s", F.col("head.doc_id").alias("class_id"), (F.col("links") + F.col("m") - 1).alias("n_links"), F.col("head.k1").alias("h1"), F.col("head.k2").alias("h2")), "lz4")
    kept = (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))
    return sig.select("doc_id", "k1", "k2", "s").join(verdicts, "s").select("doc_id", "k1", "k2", "class_id", "n_links", kept.alias("kept"))
