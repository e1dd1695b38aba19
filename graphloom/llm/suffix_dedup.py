"""Removes repeated byte strings, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Candidate contexts (see repeats) of one anchor or more are joined into a text with unique ends. From its suffix array follow the transform and the backward
step. Breadth-first backward extension then derives the longest common prefixes of neighbouring suffixes by increasing value: a boundary
between two suffixes at length l, extended by the character before them, is a boundary at l + 1 between the extended suffixes. It stops at the
minimum length: suffixes that no boundary parts by then share that many bytes. Nothing is computed about longer prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from graphloom.llm.common import U64, mix
from graphloom.llm.repeats import PowerSums, cover, runs_of, with_hits

#: Bytes hashed for an anchor; bits that number positions; bytes of one pass, which longer texts are cut into with overlap.
GRAM, PLACE_BITS, PIECE = 48, 26, 32 << 20


def byte_codes() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive items, from prefix and suffix minima of blocks of w."""
    m = len(x) - w + 1
    padded = np.concatenate((x, np.full(-len(x) % w, np.iinfo(U64).max, U64))).reshape(-1, w)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:m], before[w - 1 : w - 1 + m])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the sorted suffixes, by doubling; 0 is an end, and no two ends are equal."""
    size = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    bits = (len(ends) + 258).bit_length()
    step = 62 // bits  # characters that fill one key
    wide = np.zeros(size + step, np.int64)
    wide[:size] = rank + 1
    key = np.zeros(size, np.int64)
    for k in range(step):
        key = key << bits | wide[k : size + k]
    while True:
        order = np.argsort(key)
        high = key[order]
        new = np.concatenate(([0], np.cumsum(high[1:] != high[:-1])))
        rank[order] = new
        if new[-1] == size - 1:
            return order
        key = rank * (size + 1)
        key[:-step] += rank[step:] + 1
        step *= 2


def prefix_boundaries(order: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """For each place of the suffix array, whether its suffix shares fewer than `length` characters with the one before."""
    size = len(order)
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    left = text[order - 1]  # the transform
    back = place[order - 1]
    by_left = np.argsort(left.astype(np.int16), kind="stable")
    same = np.full(size, -1)  # the place before with the same character
    same[by_left[1:]] = np.where(left[by_left[1:]] == left[by_left[:-1]], by_left[:-1], -1)
    real = np.flatnonzero(left)
    at_or_after = np.append(real, size)[np.cumsum(left != 0) - (left != 0)]  # the next place with a character, not an end, before it
    changes = np.concatenate(([True], left[real][1:] != left[real][:-1])) if len(real) else np.zeros(0, bool)
    heads = real[changes]  # where runs of equal characters begin, over the ends between them
    begun = np.zeros(size + 1, np.int64)
    begun[heads + 1] = 1
    begun = np.cumsum(begun)  # heads before a place

    head = text[order]
    bound = np.concatenate(([True], head[1:] != head[:-1])) | (head == 0)
    new = np.flatnonzero(bound)
    active = np.flatnonzero(~bound[back])
    scratch = np.empty(size, np.int64)
    older = ahead = None
    for level in range(1, length):
        if not len(new):
            break
        found = None
        if len(new) * 6 < size:
            if older is None or level % 24 == 0:
                older = np.append(np.flatnonzero(bound), size)
                ahead = np.cumsum(bound)
            found = _near(new, older.take(ahead.take(new)), same, at_or_after, heads, begun, size)
        if found is None:
            active = active[~bound[back[active]]]
            mark = np.zeros(size + 1, np.int32)
            mark[new + 1] = 1
            mark = np.cumsum(mark, dtype=np.int32)  # boundaries before a place
            found = active[mark.take(active + 1) > mark.take(same.take(active) + 1)]
        to = back.take(found)
        to = to.compress(~bound.take(to))
        bound[to] = True
        turn = np.arange(len(to))
        scratch[to] = turn
        new = to.compress(scratch.take(to) == turn)  # each once
    return bound


def _near(new: np.ndarray, end: np.ndarray, same: np.ndarray, at_or_after: np.ndarray, heads: np.ndarray, begun: np.ndarray, size: int) -> np.ndarray | None:
    """Places whose last equal character lies before a new boundary at or before them, up to the next older boundary `end`. These are among the first
    place and the heads of runs of equal characters behind it; None if there are so many that a pass over all places is faster."""
    p = at_or_after.take(new)
    inside = (p < end).nonzero()[0]
    new, p, end = new.take(inside), p.take(inside), end.take(inside)
    low = begun.take(p + 1)
    count = begun.take(end) - low
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    if total > size // 2 + 2000:
        return None
    behind = heads.take(np.repeat(low - ends + count, count) + np.arange(total))
    return np.concatenate((p.compress(same.take(p) < new), behind.compress(same.take(behind) < np.repeat(new, count))))


class ByteRepeats:
    """Windows of `window` bytes; their anchor is the leftmost GRAM-byte string with the least hash."""

    def __init__(self, window: int = 400):
        if window < 2 * GRAM:
            raise ValueError(f"windows of {2 * GRAM} bytes at least")
        self.window = window
        self.body_bytes = 2 * window
        self.codes = byte_codes()

    def occurrences(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        out = []
        if len(data) <= PIECE:
            out.append(self._piece(data, offsets, 0))
        else:  # few rows: slices() leaves one that is this long alone
            for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                for at in range(a, max(a + 1, b - self.window + 1), PIECE):
                    r, akey, ckey, s, n = self._piece(data[at : min(b, at + PIECE + self.window - 1)], np.array([0, min(b, at + PIECE + self.window - 1) - at]), row)
                    out.append((r, akey, ckey, s + at - a, n))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _piece(self, data: np.ndarray, offsets: np.ndarray, row0: int):
        w = self.window
        windows = np.maximum(np.diff(offsets) - w + 1, 0)
        total = int(windows.sum())
        if not total:
            return (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        sums = PowerSums(self.codes[data])
        at = np.arange(len(data) - GRAM + 1)
        grams = sums.of(at, at + GRAM)
        mask = U64((1 << PLACE_BITS) - 1)
        least = sliding_min((grams & ~mask) | at.astype(U64), w - GRAM + 1)
        row = np.repeat(np.arange(len(windows)), windows)
        ends = np.cumsum(windows)
        p = np.arange(total) - np.repeat(ends - windows, windows) + offsets[row]
        chosen = (least[p] & mask).astype(np.int64)
        edge, n = runs_of(chosen, p, row)
        s, a = p[edge], chosen[edge]
        ckey = sums.of(s, s + n - 1 + w) ^ mix(n.astype(U64))
        return row[edge] + row0, grams[a], ckey, s - offsets[row[edge]], n

    def bodies(self, text: str, at: np.ndarray, n: np.ndarray) -> list[bytes]:
        raw = text.encode()
        return [raw[a : a + k - 1 + self.window] for a, k in zip(at.tolist(), n.tolist(), strict=True)]

    def window_keys(self, body: bytes, n: int) -> np.ndarray:
        at = np.arange(n)
        return PowerSums(self.codes[np.frombuffer(body, np.uint8)]).of(at, at + self.window)

    def part_keys(self, bodies: list[bytes], n: np.ndarray) -> list[np.ndarray]:
        """A window's halves have least strings as well; a key is the pair of them."""
        half = self.window // 2
        sizes = np.array([len(x) for x in bodies])
        sums = PowerSums(self.codes[np.frombuffer(b"".join(bodies), np.uint8)])
        at = np.arange(sizes.sum() - GRAM + 1)
        least = sliding_min(sums.of(at, at + GRAM), half - GRAM + 1)
        ends = np.cumsum(n)
        start = np.repeat(np.cumsum(sizes) - sizes - ends + n, n) + np.arange(ends[-1])
        keys = mix(least[start] * U64(0x9E3779B97F4A7C15) + least[start + self.window - half])
        first = np.ones(len(keys), bool)  # runs of equal keys; a key may come twice in a context
        first[1:] = keys[1:] != keys[:-1]
        first[ends[:-1]] = True
        cuts = np.concatenate(([0], np.cumsum(first)))[np.concatenate(([0], ends))]
        keys = keys[first]
        return [np.unique(keys[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def compare(self, group: np.ndarray, bodies: list[bytes], n: np.ndarray, m: np.ndarray) -> np.ndarray:
        sizes = np.array([len(x) + 1 for x in bodies])
        text = np.zeros(int(sizes.sum()), np.int32)
        begins = np.cumsum(sizes) - sizes
        for a, body in zip(begins, bodies, strict=True):
            text[a : a + len(body)] = np.frombuffer(body, np.uint8)
            text[a : a + len(body)] += 1
        order = suffix_array(text)
        bound = prefix_boundaries(order, text, self.window)
        same = np.empty(len(text), np.int64)
        same[order] = np.cumsum(bound) - 1
        ends = np.cumsum(n)
        start = np.repeat(begins, n) + np.arange(ends[-1]) - np.repeat(ends - n, n)
        count = np.bincount(same[start], np.repeat(m, n))
        return count[same[start]] > 1


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 400, with_kept: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with with_kept the bytes that are left and the removed spans.

    Every byte covered by a string of `window` bytes that starts anywhere else as well is removed. Null texts are empty; texts shorter than
    the window lose nothing. Repeated rows are copies of each other and lose all that a window covers. An empty table gives an empty result.
    """
    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds[id_col]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start long, end long>>" * with_kept

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, body, hits in zip(*(batch.column(x) for x in ("doc_id", "text", "hits")), strict=True):
                raw, edge = (body.as_py() or "").encode(), np.zeros(0, np.int64)
                kept = raw
                if hits.is_valid:
                    gone = cover(len(raw), hits.as_py(), window)
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                row = {"doc_id": doc_id.as_py(), "n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(edge) // 2, "kept_sha256": hashlib.sha256(kept).hexdigest()}
                rows.append(row | ({"kept": kept, "spans": [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]} if with_kept else {}))
            names = list(rows[0]) if rows else []
            fixed = {"doc_id": batch.schema.field("doc_id").type, "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.binary(), "kept_sha256": pa.string()}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], fixed.get(k, pa.int64())) for k in names], names)

    return with_hits(docs, ByteRepeats(window), id_col, text).mapInArrow(finish, schema)
