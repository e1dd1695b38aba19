"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so a MinHash of a whole document says nothing about an item inside it. Every document is cut into
blocks of shingles; MinHash values merge by taking minima, so overlapping segments of any size come from the same block values. Items are partitioned
by size, each size class is searched in segments of about its own size, and the number of hash functions follows from the lowest Jaccard
similarity at which the wanted containment can appear in such a segment. Where that asks for more functions than MOST_FUNCTIONS, every shingle of the item is looked
up instead, which misses nothing. What shares a value is verified by exact containment of word shingles. Items of one to four words are found at any place by their word run.

One function folds the case of items, documents and what is verified: code point by code point, as lower() of SQL does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import U64, gram_hashes, hash_strings, shingles, slices, word_hashes

#: Shingles of the smallest block; items, and bytes of their texts, that one pass over the documents searches for.
BLOCK, ITEMS_PER_PASS, BYTES_PER_PASS = 16, 20_000, 16 << 20
#: Chance that a contained item shares no value with its segment, and hash functions at most; items that ask for more are looked up shingle by shingle.
MISS, MOST_FUNCTIONS = 1e-7, 512
SHINGLE_WORDS = 5


@dataclass
class SizeClass:
    """Items whose number of shingles is near one power of two: segments of `span` blocks of `merge` base blocks each. Values of function i are in values[i]."""

    merge: int
    span: int
    functions: int
    values: list[np.ndarray]
    owners: list[list[list[int]]]


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 2**63, n, dtype=U64) * U64(2) + U64(1), rng.integers(0, 2**63, n, dtype=U64)


def folded(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


def tokens(folded_text: str) -> list[str]:
    """Words; only ASCII white space parts them, as in split_words."""
    return [w for w in folded_text.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]


def grams(words: list[str], n: int = SHINGLE_WORDS) -> set[tuple[str, ...]]:
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def size_classes(items: list[set[tuple[str, ...]]], hashes: list[np.ndarray], containment: float) -> tuple[list[SizeClass], np.ndarray, np.ndarray]:
    """The classes of these items. Items of one or two shingles, or of so low a similarity that MOST_FUNCTIONS don't do, need no MinHash: each shingle is its own segment, in a class of merge 0."""
    by: dict[tuple[int, int], list[int]] = {}
    for k, x in enumerate(hashes):
        q = len(x)
        if q:
            power = max(0, math.ceil(math.log2(q / BLOCK)))
            key = (0, 1) if q <= 2 else (1, 2) if q <= BLOCK else (max(1, 1 << (power - 1)), 3)
            by.setdefault(key, []).append(k)
    needed = {}
    for (merge, span), members in list(by.items()):
        segment = max(1, merge * span * BLOCK)
        low = min(max(1, math.ceil(containment * len(hashes[k]))) / (segment + len(hashes[k]) - math.ceil(containment * len(hashes[k]))) for k in members)
        functions = 1 if merge == 0 or low >= 1 else math.ceil(math.log(MISS) / math.log1p(-low))
        if functions > MOST_FUNCTIONS:
            by.setdefault((0, 1), []).extend(by.pop((merge, span)))
        else:
            needed[merge, span] = functions
    if (0, 1) in by:
        needed[0, 1] = 1
    a, b = multipliers(max(needed.values(), default=1))
    classes = []
    for (merge, span), members in sorted(by.items()):
        values, owners = [], []
        for i in range(needed[merge, span]):
            found: dict[int, list[int]] = {}
            for k in members:
                for v in hashes[k] if merge == 0 else [(hashes[k] * a[i] + b[i]).min()]:
                    found.setdefault(int(v), []).append(k)
            order = sorted(found)
            values.append(np.array(order, U64))
            owners.append([found[v] for v in order])
        classes.append(SizeClass(merge, span, needed[merge, span], values, owners))
    return classes, a, b


def candidates(h: np.ndarray, starts: np.ndarray, classes: list[SizeClass], a: np.ndarray, b: np.ndarray) -> set[tuple[int, int]]:
    """(row, item) pairs that share a MinHash value in some segment."""
    out: set[tuple[int, int]] = set()

    def hits(values: np.ndarray, rows: np.ndarray, c: SizeClass, i: int) -> None:
        want = c.values[i]
        table = np.zeros(1 << 16, bool)
        table[(want >> U64(48)).astype(np.int64)] = True
        maybe = np.flatnonzero(table[(values >> U64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(want, values[maybe]), len(want) - 1)
        good = want[at] == values[maybe]
        pairs = np.unique(np.stack([rows[maybe[good]], at[good]]), axis=1)
        out.update((int(r), k) for r, v in pairs.T for k in c.owners[i][v])

    size = np.diff(starts)
    blocks = -(-size // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))
    if not first[-1]:
        return out
    rows = np.repeat(np.arange(len(size)), blocks)
    inside = np.arange(first[-1]) - first[rows]
    at = np.minimum(inside[:, None] * BLOCK + np.arange(BLOCK), size[rows][:, None] - 1) + starts[rows][:, None]
    cut = h[at]
    for c in classes:
        if c.merge == 0:
            hits(h, np.repeat(np.arange(len(size)), size), c, 0)
    for i in range(max((c.functions for c in classes if c.merge), default=0)):
        level, merged = (cut * a[i] + b[i]).min(axis=1), 1
        for c in classes:
            if c.merge and i < c.functions:
                while merged < c.merge:  # minima over windows of twice as many blocks; one that reaches over the row's end only adds candidates
                    level = np.minimum(level, np.concatenate((level[merged:], level[-1:].repeat(min(merged, len(level))))))[: len(rows)]
                    merged *= 2
                far = level
                for step in range(1, c.span):
                    shift = step * merged
                    far = np.minimum(far, np.concatenate((level[shift:], level[-1:].repeat(min(shift, len(level)))))[: len(rows)])
                hits(far, rows, c, i)
    return out


def contained_items(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", containment: float = 0.8, out: str = "_items") -> DataFrame:
    """All of docs' columns for each row, and `out`, a name that docs doesn't have: array of struct (item_id, n_shingles, n_shared, containment) of the items it contains.

    An item is contained if at least `containment` of its distinct shingles (five lower-cased words) are among the document's; one of one to four words, which is one
    shingle, if its words follow each other somewhere in the document. Rows stay as they are, repeated ones too. Null or empty documents contain nothing, null or empty items are in
    nothing; item ids keep their type, null ones too. Empty tables of items give empty arrays. Nothing is shuffled; the items are the query set and are sent to the executors in blocks of
    ITEMS_PER_PASS rows and BYTES_PER_PASS bytes, or one longer item, each searched in one pass over all documents.
    """
    if out in docs.columns:
        raise ValueError(f"{out} is a column already")
    if not 0 < containment <= 1:
        raise ValueError("containment lies above 0 and is at most 1")
    kind = dict(items.dtypes)[item_id]
    queries = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).toLocalIterator()
    found = docs.withColumn(out, F.expr(f"cast(array() as array<struct<item_id {kind}, n_shingles long, n_shared long, containment double>>)"))
    block: list[tuple] = []
    size = 0
    for row in queries:
        block.append((row.item_id, row.text))
        size += len(row.text.encode())
        if len(block) >= ITEMS_PER_PASS or size >= BYTES_PER_PASS:
            found, block, size = _one_pass(found, block, text, containment, out), [], 0
    return _one_pass(found, block, text, containment, out) if block else found


def short_runs(words: list[list[str]]) -> dict[int, tuple[np.ndarray, dict[int, list[int]]]]:
    """By length, the hashes of items of fewer words than a shingle, and the items of each hash."""
    out = {}
    for n in range(1, SHINGLE_WORDS):
        own = [k for k, x in enumerate(words) if len(x) == n]
        if own:
            h = gram_hashes(hash_strings(pa.array([w for k in own for w in words[k]])), n)[::n]
            of: dict[int, list[int]] = {}
            for k, x in zip(own, h.tolist(), strict=True):
                of.setdefault(x, []).append(k)
            out[n] = (np.unique(h), of)
    return out


def _one_pass(docs: DataFrame, block: list[tuple], text: str, containment: float, out: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = [x for x, _ in shared.value]
        words = [tokens(x) for x in folded(pa.array([x for _, x in shared.value], pa.string())).to_pylist()]
        sets = [grams(x, min(len(x), SHINGLE_WORDS)) if x else set() for x in words]
        h, starts = word_hashes(pa.array([" ".join(x) if len(x) >= SHINGLE_WORDS else "" for x in words], pa.string()))
        sh, to = shingles(h, starts, SHINGLE_WORDS)
        classes, a, b = size_classes(sets, [np.unique(sh[to[k] : to[k + 1]]) for k in range(len(ids))], containment)
        short = short_runs(words)
        for batch in batches:
            for part in slices(batch, text):
                texts = folded(part.column(text))
                h, starts = word_hashes(texts)
                sh, to = shingles(h, starts, SHINGLE_WORDS)
                pairs = candidates(sh, to, classes, a, b)
                for n, (wanted, of) in short.items():
                    own = gram_hashes(h, n)
                    for p in np.flatnonzero(np.isin(own, wanted)).tolist():
                        row = int(np.searchsorted(starts, p, "right")) - 1
                        if p + n <= starts[row + 1]:
                            pairs.update((row, k) for k in of[int(own[p])])
                found: dict[int, list[int]] = {}
                for row, k in sorted(pairs):
                    found.setdefault(row, []).append(k)
                if not found:
                    yield part
                    continue
                place = part.schema.get_field_index(out)
                lists = part.column(place).to_pylist()
                for row, ks in found.items():
                    w = tokens(texts[row].as_py())
                    own = {n: grams(w, n) for n in {min(len(words[k]), SHINGLE_WORDS) for k in ks}}
                    for k in ks:
                        n = len(sets[k] & own[min(len(words[k]), SHINGLE_WORDS)])
                        if n and n >= containment * len(sets[k]):
                            lists[row].append({"item_id": ids[k], "n_shingles": len(sets[k]), "n_shared": n, "containment": n / len(sets[k])})
                yield part.set_column(place, part.schema.field(place), pa.array(lists, part.schema.field(place).type))

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", containment: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment for each row of docs and item that it contains; see contained_items."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = contained_items(narrow, items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")), containment=containment)
    return found.select("doc_id", F.explode("_items").alias("i")).select("doc_id", "i.*")
