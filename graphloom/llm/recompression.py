"""Removes repeated word windows, by recompression.

Words are named by hashes. Each round names runs of equal symbols, then pairs: a coin from the symbol's name and the round puts each symbol left or
right, and a left symbol followed by a right one becomes a new symbol. Names depend on what they stand for and on nothing else, so all
tasks give equal strings equal names without a dictionary of the corpus being shuffled (its distinct pairs are nearly as many as its words).

A symbol of the last round also has the stretch of words that fixed it and its borders. A window that holds this stretch would give the same symbol in any other
place: the interior symbols of equal windows agree. The window's anchor is the certified symbol with the least name, its key
the words of its stretch. Shared keys reveal repeats. Contexts of a shared anchor that are equal by two 64-bit hashes are copies; the windows of those that differ are compared
word by word, or, where an anchor has more contexts than a task should hold, by 64-bit hashes. A window without such a symbol, as in a long run of one word, is its own anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import U64, gram_hashes, hash_strings, mix, split_words, word_hashes
from graphloom.llm.repeats import PowerSums, cover, runs_of, with_hits

ROUNDS, PLACE_BITS = 2, 26
#: Words that are named at once; longer texts are cut. Their symbols fit PLACE_BITS.
PIECE_WORDS = 1 << 24


def name_symbols(h: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of all symbols of the last round, first place of the words that fix each, end of those, and which symbols end a text.

    Places count two more for each text before, so that what a text's border fixes, which no window shows, lies outside of the text.
    """
    texts = len(starts) - 1
    size = np.diff(starts)
    row = np.repeat(np.arange(texts), size + 1)
    first = np.concatenate(([0], np.cumsum(size + 1)))
    end = np.zeros(first[-1], bool)
    end[first[1:] - 1] = True
    edge = np.zeros(first[-1], bool)
    edge[first[:-1]] = True
    name = np.zeros(first[-1], U64)
    name[~end] = h
    lo = np.arange(first[-1]) + row
    hi = lo.copy()
    before, beyond = lo[edge] - 1, hi[end] + 1  # from the first step on, a border that no neighbour's symbols fix

    def drop(gone: np.ndarray) -> None:
        nonlocal name, lo, hi, end, edge
        low, high = lo.copy(), hi.copy()
        low[1:], high[:-1] = lo[:-1], hi[1:]
        low[edge], high[end] = before, beyond
        keep = ~gone
        name, lo, hi, end, edge = name[keep], low[keep], high[keep], end[keep], edge[keep]

    for step in range(rounds):
        inner = ~edge & ~end
        gone = np.zeros(len(name), bool)
        gone[1:] = inner[1:] & (name[1:] == name[:-1])
        length = np.diff(np.append(np.flatnonzero(~gone), len(name)))
        named = name[~gone]
        named = np.where(length > 1, mix(named + mix(length.astype(U64) + U64(step << 40))), named)
        drop(gone)
        name = named
        coin = (mix(name ^ mix(np.array([step + 1], U64))) >> U64(63)).astype(bool)
        gone = np.zeros(len(name), bool)
        gone[1:] = ~edge[1:] & ~end[1:] & coin[1:] & ~coin[:-1]
        pair = np.append(gone[1:], False)
        named = name.copy()
        named[pair] = mix(name[pair] * U64(0x9E3779B97F4A7C15) + mix(name[np.flatnonzero(pair) + 1]) + U64(step))
        named = named[~gone]
        drop(gone)
        name = named
    return name, lo, np.append(hi[1:], np.iinfo(np.int64).max), end


class WordRepeats:
    """Windows of `window` words; see the module."""

    def __init__(self, window: int = 35, rounds: int = ROUNDS):
        self.window, self.rounds = window, rounds
        self.body_bytes = 18 * window

    def occurrences(self, texts: pa.Array):
        h, starts = word_hashes(texts)
        if len(h) <= PIECE_WORDS:
            return self._piece(h, starts, 0)
        out = []  # a window's anchor depends on the window alone, so that pieces that overlap by all but one of its words have the same anchors
        for row, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            for at in range(a, max(a + 1, b - self.window + 1), PIECE_WORDS):
                to = min(b, at + PIECE_WORDS + self.window - 1)
                rows, key, ckey, s, n = self._piece(h[at:to], np.array([0, to - at]), row)
                out.append((rows, key, ckey, s + (at - a), n))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _piece(self, h: np.ndarray, starts: np.ndarray, first: int):
        w = self.window
        windows = np.maximum(np.diff(starts) - w + 1, 0)
        total = int(windows.sum())
        if not total:
            return (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        name, lo, hi, _ = name_symbols(h, starts, self.rounds)
        row = np.repeat(np.arange(len(windows)), windows)
        ends = np.cumsum(windows)
        p = np.arange(total) - np.repeat(ends - windows, windows) + starts[row]
        place = p + 2 * row
        a = np.searchsorted(lo, place, "left")
        b = np.searchsorted(hi, place + w, "right") - 1
        mask = U64((1 << PLACE_BITS) - 1)
        table = (mix(name) & ~mask) | (np.arange(len(name)).astype(U64) & mask)
        certified = b >= a
        chosen = -1 - p  # its own anchor
        width = np.where(certified, b - a + 1, 0)
        for k in range(int(width.max()).bit_length()):
            of = np.flatnonzero((width >> k) == 1)
            if len(of):
                chosen[of] = (np.minimum(table[a[of]], table[b[of] - (1 << k) + 1]) & mask).astype(np.int64)
            table = np.minimum(table[: -(1 << k)], table[(1 << k) :]) if len(table) > 1 << k else table
        edge, n = runs_of(chosen, p, row)
        s, c = p[edge], chosen[edge]
        sums = PowerSums(h)
        ckey = sums.of(s, s + n - 1 + w) ^ mix(n.astype(U64))
        at = np.maximum(c, 0)
        shift = 2 * row[edge]
        key = sums.of(np.where(c >= 0, lo[at] - shift, s), np.where(c >= 0, hi[at] - shift, s + w)) ^ mix((c >= 0).astype(U64) + U64(7))
        return row[edge] + first, key, ckey, s - starts[row[edge]], n

    def bodies(self, text: str, at: np.ndarray, n: np.ndarray) -> list[bytes]:
        words = text.encode().split()
        return [b" ".join(words[a : a + k - 1 + self.window]) for a, k in zip(at.tolist(), n.tolist(), strict=True)]

    def window_keys(self, body: bytes, n: int) -> np.ndarray:
        return gram_hashes(hash_strings(pa.array(body.split(), pa.binary()).cast(pa.string())), self.window)[:n]

    def part_keys(self, bodies: list[bytes], n: np.ndarray) -> None:
        return None

    def compare(self, group: np.ndarray, bodies: list[bytes], n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Windows are sorted into classes by hashes, and each is compared with the first of its class word by word."""
        codes, words, starts = split_words(pa.array(bodies, pa.binary()).cast(pa.string()))
        ends = np.cumsum(n)
        start = np.repeat(starts[:-1], n) + np.arange(ends[-1]) - np.repeat(ends - n, n)
        own = np.repeat(group, n).astype(U64)
        keys = gram_hashes(hash_strings(words)[codes], self.window)[start] ^ mix(own + U64(1))
        _, first, of = np.unique(keys, return_index=True, return_inverse=True)
        same = own == own[first[of]]
        for k in range(self.window):
            same &= codes[start + k] == codes[start[first[of]] + k]
        for k in np.flatnonzero(~same):  # two different windows of one hash: none is expected
            alike = np.flatnonzero(of == of[k])
            of[k] = len(first) + next(int(j) for j in alike if own[j] == own[k] and (codes[start[j] : start[j] + self.window] == codes[start[k] : start[k] + self.window]).all())
        return np.bincount(of, np.repeat(m, n))[of] > 1


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 35, with_kept: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256, and with with_kept the text of the words that are left.

    Every word covered by a window of `window` words that starts anywhere else as well is removed. Null texts have no words; texts shorter than
    the window lose nothing; texts longer than PIECE_WORDS are cut into overlapping pieces. Repeated rows are copies of each other. An empty table gives an empty result. Other columns aren't read.
    """
    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds[id_col]}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_kept

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, sha, left = [], [], [], []
            for body, hits in zip(batch.column("text"), batch.column("hits"), strict=True):
                words = (body.as_py() or "").encode().split()
                kept = words
                if hits.is_valid:
                    gone = cover(len(words), hits.as_py(), window)
                    kept = [x for x, y in zip(words, gone.tolist(), strict=True) if not y]
                rest = b" ".join(kept)
                n.append(len(words))
                removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(rest).hexdigest())
                left.append(rest.decode() if with_kept else None)
            out = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            if with_kept:
                out["kept"] = pa.array(left, pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return with_hits(docs, WordRepeats(window), id_col, text).mapInArrow(finish, schema)
