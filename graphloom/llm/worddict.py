"""Documents as codes into dictionaries of distinct words.

A corpus has far more words than distinct words, so what holds for a word is computed and joined once for each distinct word, not for each
occurrence. A chunk of documents of bounded size gets a dictionary of its words; documents become sequences of codes. Dictionary rows are joined
globally by word, then brought back to their chunk, where the documents' positions are filled in. Only dictionaries and packed codes are shuffled, never
the occurrences, and no task holds more than one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from graphloom.common import partitions
from graphloom.llm.common import split_words

#: Bytes of text in a chunk, and words in a packed run of documents; a longer document forms one of its own.
CHUNK_BYTES, RUN_WORDS = 8 << 20, 1 << 18
#: Stands for the end of a text where one is asked for; no word is empty.
END = ""


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative numbers below 2^32, compressed by planes of bytes."""
    return zstandard.ZstdCompressor(level=3).compress(np.frombuffer(numbers.astype("<u4").tobytes(), np.uint8).reshape(-1, 4).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def pack_words(words: list[str]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress("\n".join(words).encode())


def unpack_words(data: bytes) -> list[str]:
    return zstandard.ZstdDecompressor().decompress(data).decode().split("\n")


def tasks(df: DataFrame) -> int:
    """Tasks that words and chunks are dealt to; their number grows with the input (see partitions). Twice the shuffle partitions, as some tasks get several chunks."""
    return 2 * partitions(df)


def word_buckets(df: DataFrame) -> int:
    """Buckets of words: one for each task, which holds the bucket's distinct words."""
    return max(64, tasks(df))


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Tables of at most limit bytes of text, or one row."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(sizes):
            ends = np.cumsum(sizes[at:])
            fit = int(np.searchsorted(ends, limit - size, "right"))
            if fit == 0 and not held:
                fit = 1
            if fit:
                held.append(batch.slice(at, fit))
                size += int(ends[fit - 1])
                at += fit
            if at < len(sizes):
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def code_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fold: bool = False, end: bool = False, counted: str | None = None) -> DataFrame:
    """Chunk dictionaries and packed documents.

    Rows of kind 0 are the words of a chunk that fall into one bucket by their hash: key (-1 - bucket), chunk, items (their codes, ascending, as differences), words, and, with
    `counted`, n (occurrences in rows for which that boolean column is true). Rows of kind 1 are runs of documents: key (the chunk), chunk, ids, sizes (words of each), data (codes).
    Codes ascend with falling frequency. fold lower-cases A to Z; end adds END to every text.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), (F.col(counted) if counted else F.lit(True)).alias("counted"))
    id_type = dict(source.dtypes)["doc_id"]
    buckets = word_buckets(docs)
    schema = f"key long, chunk long, kind int, items binary, words binary, n binary, ids array<{id_type}>, sizes array<long>, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        for k, held in enumerate(chunks(batches)):
            texts = pc.fill_null(held.column("text").combine_chunks(), "")
            codes, words, starts = split_words(pc.ascii_lower(texts) if fold else texts)
            size = np.diff(starts)
            counting = held.column("counted").to_numpy().astype(bool)
            n = np.bincount(codes[np.repeat(counting, size)], minlength=len(words))
            total = np.bincount(codes, minlength=len(words))
            names = words.to_pylist()
            if end:
                ended = np.full(len(codes) + len(size), len(names), np.int64)
                ended[np.arange(len(codes)) + np.repeat(np.arange(len(size)), size)] = codes
                codes, size, starts = ended, size + 1, starts + np.arange(len(starts))
                n, total, names = np.append(n, counting.sum()), np.append(total, len(size)), [*names, END]
            order = np.argsort(-total, kind="stable")
            order = order[total[order] > 0]
            rank = np.zeros(len(names), np.int64)
            rank[order] = np.arange(len(order))
            h = xxhash.xxh64_intdigest
            ranked = [names[x] for x in order]
            bucket = np.fromiter((h(w) % buckets for w in ranked), np.int64, len(ranked))
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            rows = []
            for at in range(buckets):
                items = by[edges[at] : edges[at + 1]]
                if len(items):
                    rows.append((-1 - at, first + k, 0, pack(np.diff(items, prepend=0)), pack_words([ranked[x] for x in items]), pack(n[order[items]]) if counted else None, None, None, None))
            at = 0
            while at < len(size):
                to = max(at + 1, int(np.searchsorted(starts, starts[at] + RUN_WORDS, "right")) - 1)
                rows.append((first + k, first + k, 1, None, None, None, held.column("doc_id").slice(at, to - at).to_pylist(), size[at:to].tolist(), pack(rank[codes[starts[at] : starts[to]]])))
                at = to
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(held.schema.field("doc_id").type), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "chunk", "kind", "items", "words", "n", "ids", "sizes", "data"])

    return source.mapInArrow(run, schema)


def fill_positions(coded: DataFrame, words: DataFrame, finish, schema: str) -> DataFrame:
    """Brings the values of dictionary words, rows of (chunk, items, value binary), back to the documents of their chunk.

    finish.prepare(items, values) gets a chunk's lists of code arrays and values and returns what finish(prepared, ids, sizes, codes), called for each run of documents, uses
    to yield record batches of `schema`. Rows of kind 0 in coded are passed over.
    """

    def run(docs: pa.Table, own: pa.Table) -> pa.Table:
        if not docs.num_rows or docs.column("kind")[0].as_py() == 0:
            return empty
        items = [np.cumsum(unpack(x.as_py())) for x in own.column("items")]
        prepared = finish.prepare(items, own.column("value").to_pylist())
        out = []
        for k in range(docs.num_rows):
            ids, sizes = docs.column("ids")[k].values, docs.column("sizes")[k].values.to_numpy()
            out += finish(prepared, ids, sizes, unpack(docs.column("data")[k].as_py()))
        return pa.Table.from_batches(out)

    empty = pa.Table.from_batches([], to_arrow_schema(T.StructType.fromDDL(schema)))
    n = tasks(coded)
    left = coded.groupBy("key")
    return left.cogroup(words.withColumnRenamed("chunk", "key").repartition(n, "key").groupBy("key")).applyInArrow(run, schema)
