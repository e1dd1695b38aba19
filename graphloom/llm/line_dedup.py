"""Removal of lines that many documents share.

A first pass over the texts fills two Bloom filters with hashes of the lines' keys, one of those seen and one of those seen in a second document. What a chunk of documents sends is its own
pair of filters in sparse form (sorted bit positions), cut into ranges; a range's task joins the pairs of all chunks: twice |= once & own; once |= own. The filter of
those seen twice, whose size is fixed, goes to all tasks, and a second pass sends only the lines in it, by hashes of 128 bits, to be counted exactly. Documents that lose lines
get a list of them; texts travel once, in that join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import scanned_bytes
from graphloom.llm.common import U64, materialize, mix, row_key, slices, unused
from graphloom.llm.worddict import chunks

SPACE = " \t\n\x0b\x0c\r"
#: Bits of each filter at least and at most (128 MB), and of a range that one task joins. A key sets two bits.
LEAST_BITS, MOST_BITS, RANGE_BITS = 20, 30, 22
#: Bytes of scanned files for each bit of a filter, and bits for each line that a filter takes on, at least. Where lines are so many that MOST_BITS would not do, the filter takes on a share of
#: all hashes and the lines of the rest are suspected without it.
BYTES_PER_BIT, BITS_PER_LINE, BYTES_PER_LINE = 8, 4, 40


def keyed_lines(texts: pa.Array, least: int) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """All lines, where each text's begin (one more at the end), the places of lines with a key of at least `least` code points, and those keys."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    long = np.flatnonzero(pc.greater_equal(pc.binary_length(lines), least).to_numpy(zero_copy_only=False))  # a code point has a byte at least
    keys = pc.ascii_lower(pc.ascii_trim(lines.take(pa.array(long)), characters=SPACE))
    keep = pc.greater_equal(pc.utf8_length(keys), least)
    return lines, starts - starts[0], long[keep.to_numpy(zero_copy_only=False)], keys.filter(keep)


def key_hashes(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each key."""
    coded = keys.dictionary_encode()
    h = np.fromiter((x for w in coded.dictionary.to_pylist() for x in divmod(xxhash.xxh3_128_intdigest(w), 1 << 64)), U64, 2 * len(coded.dictionary)).reshape(-1, 2)
    return tuple(h[coded.indices.to_numpy(zero_copy_only=False)].T) if len(keys) else (np.zeros(0, U64), np.zeros(0, U64))


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """Two bits for each hash, as rows."""
    return np.stack([mix(h) >> U64(64 - bits), mix(h ^ U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)]).astype(np.int64)


def packed(at: np.ndarray) -> bytes:
    """Ascending positions by their differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(at, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64))


def filter_bits(docs: DataFrame) -> tuple[int, int]:
    """Logarithm of the filters' bits, and the hash up to which (in units of 2^-32 of all hashes) they take on lines. A matter of speed only."""
    size = scanned_bytes(docs)
    bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_PER_BIT).bit_length()))
    return bits, min(1 << 32, ((1 << bits) << 32) // max(1, size // BYTES_PER_LINE * BITS_PER_LINE))


def seen_twice(docs: DataFrame, text: str, least: int, bits: int, covered: int) -> bytes:
    """The filter of keys that may be in two rows of docs."""
    across = max(0, bits - RANGE_BITS)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in chunks(batches):
            once, twice = [], []
            for part in held.to_batches():
                for texts in slices(part):
                    _, starts, at, keys = keyed_lines(texts.column("text"), least)
                    h, _ = key_hashes(keys)
                    row = np.searchsorted(starts, at, "right")
                    order = np.lexsort((row, h))
                    h, row = h[order], row[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                    h = h[new]
                    once.append(h[(h >> U64(32)) < U64(covered)])
            h, n = np.unique(np.concatenate(once) if once else np.zeros(0, U64), return_counts=True)
            a = positions(h, bits)
            # a bit that two keys share may be in both filters: it only makes more lines suspected
            parts = [np.unique(a), np.unique(a[:, n > 1])]
            rows = []
            edges = [np.searchsorted(x, np.arange((1 << across) + 1) << (bits - across)) for x in parts]
            for k in range(1 << across):
                once, twice = (x[e[k] : e[k + 1]] - (k << (bits - across)) for x, e in zip(parts, edges, strict=True))
                if len(once):
                    rows.append((k, packed(once), packed(twice)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["range", "once", "twice"])

    def joined(table: pa.Table) -> pa.Table:
        once, twice = (np.zeros(1 << (bits - across), bool) for _ in range(2))
        for a, b in zip(table.column("once"), table.column("twice"), strict=True):
            new = unpacked(a.as_py())
            twice[new[once[new]]] = True
            twice[unpacked(b.as_py())] = True
            once[new] = True
        return pa.table([table.column("range").slice(0, 1).combine_chunks(), pa.array([zstandard.ZstdCompressor(level=1).compress(np.packbits(twice).tobytes())])], ["range", "twice"])

    pairs = docs.select(F.col(text).alias("text")).mapInArrow(own, "range int, once binary, twice binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = len(out) >> across
    for r in pairs.groupBy("range").applyInArrow(joined, "range int, twice binary").toLocalIterator():
        out[r.range * size : (r.range + 1) * size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.twice)), np.uint8)
    return out.tobytes()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 40, most_docs: int = 5) -> DataFrame:
    """k1, k2 (row_key of id and text), gone: the hashes of the lines that the row loses, for rows that lose any."""
    bits, covered = filter_bits(docs)
    twice = docs.sparkSession.sparkContext.broadcast(seen_twice(docs, text, least, bits, covered))  # of a fixed size, see MOST_BITS

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(twice.value, np.uint8)
        for batch in batches:
            for part in slices(batch):
                _, starts, at, keys = keyed_lines(part.column("text"), least)
                h1, h2 = key_hashes(keys)
                a = positions(h1, bits)
                maybe = ((filled[a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & 1).all(0) | ((h1 >> U64(32)) >= U64(covered))
                h1, h2, row = h1[maybe], h2[maybe], np.searchsorted(starts, at[maybe], "right") - 1
                order = np.lexsort((h2, h1, row))
                h1, h2, row = h1[order], h2[order], row[order]
                new = np.ones(len(row), bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (row[1:] != row[:-1])
                of = pa.array(row[new])
                yield pa.RecordBatch.from_arrays([pa.array(h1[new].view(np.int64)), pa.array(h2[new].view(np.int64)), *(part.column(c).take(of) for c in ("doc_id", "k1", "k2"))], ["h1", "h2", "doc_id", "k1", "k2"])

    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), *row_key(id_col, text))
    found = materialize(source.mapInArrow(suspects, f"h1 long, h2 long, doc_id {kind}, k1 long, k2 long"), "lz4")
    lines = found.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("stays")).filter(F.col("n") >= most_docs)
    gone = found.join(materialize(lines.drop("n"), "lz4"), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("stays")))
    return gone.groupBy("k1", "k2").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 40, most_docs: int = 5) -> DataFrame:
    """doc_id, kept (the text without the lines it loses), n_lines, n_dropped, for each row of docs.

    A line's key is the line without white space at its ends, A to Z lower-cased. Keys of at least `least` code points in `most_docs` documents or more lose all their lines but those of the
    largest id that has them. Rows with one id are one document; rows without id are one that comes before all others. A null text has one empty line. Very long texts are split in slices of
    their own; repeated rows are treated alike. An empty table gives an empty result; other columns aren't read.
    """
    k1, k2 = (unused(docs, c) for c in ("_k1", "_k2"))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), *(c.alias(n) for c, n in zip(row_key(id_col, text), (k1, k2), strict=True)))
    gone = materialize(repeated_lines(docs, id_col, text, least, most_docs), "lz4").withColumnsRenamed({"k1": k1, "k2": k2})
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, kept string, n_lines long, n_dropped long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lines, starts, at, keys = keyed_lines(part.column("text"), least)
                h1, h2 = key_hashes(keys)
                row = np.searchsorted(starts, at, "right") - 1
                lists = part.column("gone")
                losing = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
                drop = np.zeros(len(lines), bool)
                for k in losing:
                    own = np.flatnonzero(row == k) if len(losing) < 8 else np.arange(*np.searchsorted(row, [k, k + 1]))
                    bad = lists[k].values
                    wanted = set(zip(bad.field("h1").to_pylist(), bad.field("h2").to_pylist(), strict=True))
                    drop[at[own[[x in wanted for x in zip(h1[own].view(np.int64).tolist(), h2[own].view(np.int64).tolist(), strict=True)]]]] = True
                texts = pc.fill_null(part.column("text"), "")
                if drop.any():
                    stays = np.concatenate(([0], np.cumsum(~drop)))
                    left = pa.ListArray.from_arrays(pa.array(stays[starts].astype(np.int32)), lines.filter(pa.array(~drop)))
                    texts = pc.binary_join(left, "\n")
                dropped = np.diff(np.concatenate(([0], np.cumsum(drop)))[starts])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), texts, pa.array(np.diff(starts)), pa.array(dropped)], ["doc_id", "kept", "n_lines", "n_dropped"])

    return source.join(gone, [k1, k2], "left").select("doc_id", "text", "gone").mapInArrow(run, schema)
