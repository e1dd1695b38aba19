"""Finds all windows of a fixed length that occur more than once in a corpus, without a row for each position.

A method picks an anchor inside every window by a rule that looks at the window alone, so equal windows have equal anchors at equal places. Consecutive
windows with one anchor form an occurrence: one row with the anchor's key and a hash of its context, the text that its windows span.
Anchors seen once are dropped by a count; equal contexts collapse to one row with their number before any text moves. Where all contexts
of a repeated anchor are equal, all their windows repeat, and so do those of any context seen twice. The texts of anchors with several contexts are fetched; contexts
that have no coarse key in common with another are left out, and the method's kernel compares the windows of the rest. An anchor with more contexts than a task should hold is split by window, counted by key, so no group is ever gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import partitions
from graphloom.llm.common import U64, materialize, mix, row_key, slices

#: Bytes of contexts of one anchor that a kernel compares at most, and of smaller groups that it takes together.
BLOCK_BYTES, BATCH_BYTES = 4 << 20, 128 << 10
STEP = U64(0x9E3779B97F4A7C15)
BACK = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Method(Protocol):
    """window: its length. body_bytes: bytes of a context at most, roughly."""

    window: int
    body_bytes: int

    def occurrences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, anchor key, context key, first start and number of starts of each occurrence."""

    def bodies(self, text: str, at: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The contexts of n starts each from `at`."""

    def window_keys(self, body: bytes, n: int) -> np.ndarray:
        """A hash of each of a context's n windows."""

    def part_keys(self, bodies: list[bytes], n: np.ndarray) -> list[np.ndarray] | None:
        """Distinct keys of the windows of each context, coarser than the windows: contexts without a key in common have no window in common. None if there is nothing coarser."""

    def compare(self, group: np.ndarray, bodies: list[bytes], n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """For the starts of all contexts in order, whether their window occurs twice or more, counting each context m times."""


class PowerSums:
    """Hashes of any stretch of a sequence of 64-bit items in constant time."""

    def __init__(self, items: np.ndarray):
        self.back = np.full(len(items) + 1, BACK, U64)
        self.back[0] = 1
        self.back = np.cumprod(self.back)
        power = np.full(len(items), STEP, U64)
        if len(items):
            power[0] = 1
        self.sums = np.concatenate((np.zeros(1, U64), np.cumsum(items * np.cumprod(power))))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def runs_of(chosen: np.ndarray, start: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of consecutive windows of a row with one anchor."""
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1]))))
    return edge, np.diff(np.append(edge, len(chosen)))


def repeated_starts(docs: DataFrame, method: Method) -> DataFrame:
    """k1, k2 (see row_key of doc_id and text), and `hits`: an array of struct (s, runs) where runs lists [from, to) pairs, relative to s, of the starts of
    repeated windows. docs has doc_id, text, k1 and k2."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, akey, ckey, s, n = method.occurrences(part.column("text"))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("k1").take(at), part.column("k2").take(at), pa.array(akey.view(np.int64)), pa.array(ckey.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], ["k1", "k2", "akey", "ckey", "s", "n"])

    found = materialize(docs.select("text", "k1", "k2").mapInArrow(find, "k1 long, k2 long, akey long, ckey long, s int, n int"), "lz4")
    keys = materialize(found.groupBy("akey").count().filter("count > 1").select("akey"), "lz4")
    seen = materialize(found.join(keys, "akey"), "lz4")
    contexts = materialize(seen.groupBy("akey", "ckey").agg(F.count("*").alias("m"), F.min(F.struct("k1", "k2", "s", "n")).alias("r")), "lz4")
    sizes = contexts.groupBy("akey").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    several = contexts.join(materialize(sizes, "lz4"), "akey", "left").withColumn("large", F.col("contexts") > BLOCK_BYTES // method.body_bytes)
    several = materialize(several, "lz4")
    alone = several.filter("contexts is null or m > 1").select("akey", "ckey", F.array(F.lit(0), F.col("r.n")).alias("runs"))

    wanted = several.filter("contexts is not null").select("r.k1", "r.k2", F.struct("akey", "ckey", "large", "m", "r.s", "r.n").alias("c")).groupBy("k1", "k2").agg(F.collect_list("c").alias("cs"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("akey", "ckey", "large", "m", "s", "n")
        for batch in batches:
            held, bodies, size = [], [], 0
            for text, cs in zip(batch.column("text"), batch.column("cs"), strict=True):
                c = {k: cs.values.field(k).to_numpy(zero_copy_only=False) for k in fields}
                own = method.bodies(text.as_py(), c["s"].astype(np.int64), c["n"].astype(np.int64))
                held.append(c)
                bodies += own
                size += sum(map(len, own))
                if size >= BATCH_BYTES:
                    yield from _fetched(method, {k: np.concatenate([c[k] for c in held]) for k in fields}, bodies)
                    held, bodies, size = [], [], 0
            if held:
                yield from _fetched(method, {k: np.concatenate([c[k] for c in held]) for k in fields}, bodies)

    # repeated rows with one id and text fetch a context more than once: the copies go
    fetched = docs.select("text", "k1", "k2").join(wanted, ["k1", "k2"]).select("text", "cs").mapInArrow(fetch, "akey long, ckey long, wkey long, n int, m long, body binary, parts array<long>")
    fetched = materialize(fetched)
    by_window = fetched.filter("wkey is not null").groupBy("akey", "ckey", "wkey", F.col("n").alias("j")).agg(F.first("m").alias("m"))
    twice = by_window.groupBy("akey", "wkey").agg(F.sum("m").alias("t")).filter("t > 1").select("akey", "wkey")
    split = by_window.filter("m = 1").join(twice, ["akey", "wkey"]).groupBy("akey", "ckey").agg(F.flatten(F.collect_list(F.array(F.col("j"), F.col("j") + 1))).alias("runs"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last, begin = 0, (None, None), 0
        for batch in batches:
            for akey, ckey, n, m, body in zip(*(batch.column(x).to_pylist() for x in ("akey", "ckey", "n", "m", "body")), strict=True):
                if last == (akey, ckey):
                    continue
                if akey != last[0]:
                    if all(x[3] > 1 for x in held[begin:]):  # each of them repeats whole
                        del held[begin:]
                    if size >= BATCH_BYTES and held:
                        yield _compared(method, held)
                        held, size = [], 0
                    begin = len(held)
                held.append((akey, ckey, n, m, body))
                size, last = size + len(body), (akey, ckey)
        if held:
            yield _compared(method, held)

    small = fetched.filter("wkey is null")
    part = small.select("akey", "ckey", F.explode("parts").alias("part"))
    shared = materialize(part.groupBy("akey", "part").count().filter("count > 1").select("akey", "part"), "lz4")
    alike = part.join(shared, ["akey", "part"]).select("akey", "ckey").distinct()
    small = small.filter("parts is null").unionByName(small.filter("parts is not null").join(alike, ["akey", "ckey"], "left_semi"))
    small = small.select("akey", "ckey", "n", "m", "body").repartition(partitions(docs), "akey").sortWithinPartitions("akey", "ckey")
    compared = small.mapInArrow(compare, "akey long, ckey long, runs array<int>")
    verdicts = materialize(reduce(DataFrame.unionByName, [alone, compared, split]).filter("size(runs) > 0"))
    return seen.join(verdicts, ["akey", "ckey"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "runs")).alias("hits"))


def _fetched(method: Method, c: dict[str, np.ndarray], bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows of contexts: those of large groups as a row for each window, without text; the others with their text and coarse keys."""
    names = ["akey", "ckey", "wkey", "n", "m", "body", "parts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    large = c["large"].astype(bool)
    for k in np.flatnonzero(large).tolist():
        n = int(c["n"][k])
        keys = method.window_keys(bodies[k], n).view(np.int64)
        same = lambda x, n=n: np.full(n, x)
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip([same(c["akey"][k]), same(c["ckey"][k]), keys, np.arange(n), same(c["m"][k]), [None] * n, [None] * n], kinds, strict=True)], names)
    small = np.flatnonzero(~large)
    if len(small):
        own = [bodies[k] for k in small.tolist()]
        parts = method.part_keys(own, c["n"][small].astype(np.int64))
        parts = [None] * len(small) if parts is None else [x.view(np.int64) for x in parts]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip([c["akey"][small], c["ckey"][small], [None] * len(small), c["n"][small], c["m"][small], own, parts], kinds, strict=True)], names)


def _compared(method: Method, held: list[tuple]) -> pa.RecordBatch:
    akey = np.array([x[0] for x in held])
    n = np.array([x[2] for x in held], np.int64)
    twice = method.compare(np.unique(akey, return_inverse=True)[1], [x[4] for x in held], n, np.array([x[3] for x in held], np.int64))
    ends = np.cumsum(n)
    runs = []
    for a, b, m in zip(ends - n, ends, (x[3] for x in held), strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], twice[a:b].astype(np.int8), [0])))) if m == 1 else np.zeros(0, np.int64)  # the others repeat whole
        runs.append(edge.tolist())
    return pa.RecordBatch.from_arrays([pa.array(akey), pa.array([x[1] for x in held], pa.int64()), pa.array(runs, pa.list_(pa.int32()))], ["akey", "ckey", "runs"])


def cover(length: int, hits: list[dict] | None, window: int) -> np.ndarray:
    """Which of a text's items lie in a repeated window."""
    delta = np.zeros(length + 1, np.int32)
    for hit in hits or []:
        runs = np.array(hit["runs"], np.int64).reshape(-1, 2) + hit["s"]
        np.add.at(delta, runs[:, 0], 1)
        np.add.at(delta, runs[:, 1] - 1 + window, -1)
    return np.cumsum(delta)[:-1] > 0


def with_hits(docs: DataFrame, method: Method, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and hits of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), *row_key(id_col, text))
    return rows.join(repeated_starts(rows, method), ["k1", "k2"], "left").select("doc_id", "text", "hits")


