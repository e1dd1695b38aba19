"""What the operators share: written intermediate tables, row keys, and columnar word splitting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.common import scratch

#: A word of every contract: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker handles at once; a longer document forms a slice of its own.
SLICE_BYTES = 4 << 20
U64 = np.uint64


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: it cuts lineage, survives lost executors and fixes row order-dependent values."""
    path = scratch(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(*cols: Column | str) -> list[Column]:
    """Two 64-bit hashes that identify a row by its contents; nulls are told apart from other values."""
    marked = [y for x in cols for y in (F.isnull(x), F.col(x) if isinstance(x, str) else x)]
    return [F.xxhash64(F.lit(1), *marked).alias("k1"), F.xxhash64(*marked, F.lit(2)).alias("k2")]


def unused(df: DataFrame, name: str) -> str:
    """name, behind as many underscores as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES):
    """Cuts a batch into runs of rows of at most limit bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words in order, the distinct words they point to, and where each row's words start (one more at the end). Null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    void = pc.index(flat.dictionary, "").as_py()
    if void >= 0:
        keep = codes != void
        starts = np.concatenate(([0], np.cumsum(keep)))[starts]
        codes = codes[keep]
    return codes, flat.dictionary, starts.astype(np.int64)


def hash_strings(words: pa.Array) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in words.to_pylist()), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64-bit numbers."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word in order, and where each row's words start."""
    codes, words, starts = split_words(texts)
    return (hash_strings(words)[codes] if len(words) else np.zeros(0, U64)), starts


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive items, at their first item; shorter by n - 1 than h."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for k in range(n):
        out = out * U64(0x9E3779B97F4A7C15) + h[k : k + m]
    return mix(out)


def shingles(h: np.ndarray, starts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row and where each row's begin. A row of 1 to n - 1 words has one shingle of all its words; a row of none, none."""
    size = np.diff(starts)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    to = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(starts[:-1] - to[:-1], count) + np.arange(to[-1])
    long = np.repeat(size >= n, count)
    out = np.zeros(to[-1], U64)
    grams = gram_hashes(h, n)
    out[long] = grams[at[long]]
    for row in np.flatnonzero((size > 0) & (size < n)):
        out[to[row]] = gram_hashes(h[starts[row] : starts[row + 1]], int(size[row]))[0] + U64(size[row])
    return out, to


def distinct_per_row(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row, and where each row's begin."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return x[first], np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=len(starts) - 1))))
