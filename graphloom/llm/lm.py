"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation in numpy.

The model predicts a token's symbol from the two symbols before it: q = sum of position matrices' rows, s(w) = q . r_w + b_w, normalised over all symbols. Symbols are
the most frequent training tokens and classes of the others, by their last two letters; their numbers grow with the cube root of the vocabulary (see symbol_numbers). A token of a
class has the class's probability times the token's share in it, (c + 1) / (N_class + V_class + 1), which leaves one share for all unseen tokens; the whole is normalised over tokens.
As contexts are pairs of symbols, the normalisers of all contexts are computed once, by batched matrix products in Spark tasks.

Counts cover every training document; they are joined to tokens by distinct words (see worddict). Embeddings are trained on all training documents. A hash deals them into groups of
GROUP_TOKENS tokens, and rounds take ever more groups: each group goes on from the common model, and the groups' models are averaged by tokens. So the result doesn't depend on files or
tasks, and what is learnt one after another grows with the logarithm of the corpus.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import partitions
from graphloom.llm.common import materialize, slices, split_words
from graphloom.llm.worddict import END, code_documents, fill_positions, pack, pack_words, tasks, unpack, unpack_words

#: Frequent tokens and classes for each unit of the vocabulary's cube root, and symbols at most: their pairs, which are broadcast, take 64 MB then.
TOP_ROOT, CLASS_ROOT, LEAST_CLASSES, MOST_SYMBOLS = 10.0, 0.7, 8, 4000
#: Classes are folded from so many bins, which are counted before their number is known.
CLASS_BINS = 4096
WIDTH, NOISE, BATCH, RATE = 32, 24, 512, 0.1
#: Training tokens of a group of texts, which one task learns from in order, and how many times as many groups each round of averaging takes as the one before.
GROUP_TOKENS, ROUND_GROWTH = 2_000_000, 4
#: Tokens that a task shuffles and trains on at once, and how often it goes through them where there are fewer in all.
FIT_TOKENS, MOST_EPOCHS = 400_000, 8


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 by 7; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def symbol_numbers(kinds: int, most: int = MOST_SYMBOLS) -> tuple[int, int]:
    """Frequent tokens and classes for a vocabulary of so many distinct tokens, `most` at most."""
    root = kinds ** (1 / 3)
    classes = min(max(1, most // 10), max(LEAST_CLASSES, math.ceil(CLASS_ROOT * root)))
    return min(most - classes, math.ceil(TOP_ROOT * root)), classes


def word_bin(word: str) -> int:
    return zlib.crc32(word[-2:].encode()) % CLASS_BINS


@dataclass
class LogBilinear:
    """Tables by symbol; the symbol after the last, BOS, stands before a text."""

    near: np.ndarray
    far: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    sums: list[np.ndarray]  # Adagrad's, by row

    @property
    def symbols(self) -> int:
        return len(self.bias)

    def tables(self) -> tuple[np.ndarray, ...]:
        return self.near, self.far, self.target, self.bias

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.tables(), *self.sums)])

    def filled(self, flat: np.ndarray) -> LogBilinear:
        """A model of the same shape with other numbers."""
        ends = np.cumsum([x.size for x in (*self.tables(), *self.sums)])
        parts = [x.reshape(y.shape).astype(np.float32) for x, y in zip(np.split(flat, ends[:-1]), (*self.tables(), *self.sums), strict=True)]
        return LogBilinear(*parts[:4], parts[4:])

    def normalisers(self, contexts: np.ndarray) -> np.ndarray:
        """log of the sum of exp(s) over all symbols, for contexts far * (symbols + 1) + near."""
        out = np.empty(len(contexts), np.float32)
        for at in range(0, len(contexts), 128):  # which stay in the processor's cache
            c = contexts[at : at + 128]
            s = (self.far[c // (self.symbols + 1)] + self.near[c % (self.symbols + 1)]) @ self.target.T
            s += self.bias
            top = s.max(1)
            s -= top[:, None]
            out[at : at + 128] = top + np.log(np.exp(s, out=s).sum(1))
        return out


def contexts_of(symbols: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The context of each token; first marks texts' first tokens."""
    padded = np.concatenate(([n, n], symbols))
    near, far = padded[1:-1].copy(), padded[:-2].copy()
    near[first] = n
    far[first] = n
    second = np.zeros(len(symbols), bool)
    second[1:] = first[:-1]
    far[second] = n
    return far.astype(np.int64) * (n + 1) + near


def untrained(unigram: np.ndarray, seed: int = 5) -> LogBilinear:
    rng = np.random.default_rng(seed)
    n = len(unigram)
    near, far, target = (rng.normal(0, 0.05, (rows, WIDTH)).astype(np.float32) for rows in (n + 1, n + 1, n))
    return LogBilinear(near, far, target, np.log(unigram).astype(np.float32), [np.full((rows, 1), 1e-3, np.float32) for rows in (n + 1, n + 1, n, n)])


def train(symbols: np.ndarray, first: np.ndarray, unigram: np.ndarray, model: LogBilinear, seed: int = 5, epochs: int = 1) -> LogBilinear:
    """Noise-contrastive estimation: tells each token from NOISE draws of the unigram distribution. Updates by Adagrad. Goes on from a model, which stays as it is."""
    n = len(unigram)
    rng = np.random.default_rng(seed)
    every, total = np.concatenate(model.tables()[:3]), np.concatenate(model.sums[:3]).ravel()  # one table, so that a batch's gradients are summed at once
    near, far, target = np.split(every, [n + 1, 2 * n + 2])
    bias, bias_total = model.bias.copy(), model.sums[3].ravel().copy()
    shift = np.log(unigram * NOISE).astype(np.float32)
    c = contexts_of(symbols, first, n)
    a, b = c // (n + 1), c % (n + 1)
    wheel = np.cumsum(unigram)
    wheel /= wheel[-1]
    for _ in range(epochs):
        order = rng.permutation(len(symbols))
        draws = np.searchsorted(wheel, rng.random((-(-len(order) // BATCH), NOISE))).clip(0, n - 1)  # one draw for the batch: dense products
        for noise, at in zip(draws, range(0, len(order), BATCH), strict=True):
            t = order[at : at + BATCH]
            w = symbols[t]
            q, own, other = near[b[t]] + far[a[t]], target[w], target[noise]
            true = np.einsum("ij,ij->i", q, own) + (bias[w] - shift[w])
            false = q @ other.T + (bias[noise] - shift[noise])
            up = 1 / (1 + np.exp(np.minimum(true, 30)))
            down = -1 / (1 + np.exp(np.minimum(-false, 30)))
            dq = up[:, None] * own + down @ other
            rows = np.concatenate([b[t], a[t] + (n + 1), w + (2 * n + 2), noise + (2 * n + 2)]).astype(np.uint16 if 3 * n + 2 < 1 << 16 else np.int32)  # short ones sort fast
            grad = np.concatenate([dq, dq, up[:, None] * q, down.T @ q])
            by = np.argsort(rows, kind="stable")
            ordered = rows[by]
            begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            kinds, g = ordered[begin], np.add.reduceat(grad[by], begin)
            total[kinds] += np.einsum("ij,ij->i", g, g) / WIDTH
            every[kinds] += g * (RATE / np.sqrt(total[kinds]))[:, None]
            db = (np.bincount(w, up, n) + np.bincount(noise, down.sum(0), n)).astype(np.float32)
            bias_total += db * db
            bias += RATE * db / np.sqrt(bias_total)
    return LogBilinear(near, far, target, bias, [*np.split(total[:, None], [n + 1, 2 * n + 2]), bias_total[:, None]])


@dataclass
class Symbols:
    """place: the frequent tokens' symbols; the classes follow."""

    place: dict[str, int]
    classes: int

    def of(self, word: str) -> int:
        at = self.place.get(word)
        return len(self.place) + word_bin(word) % self.classes if at is None else at

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts' tokens, each text followed by its end, and which are the first of a text."""
        codes, words, starts = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
        own = np.fromiter((self.of(w) for w in words.to_pylist()), np.int64, len(words))
        size = np.diff(starts)
        out = np.full(len(codes) + len(size), self.of(END), np.int64)
        out[np.arange(len(codes)) + np.repeat(np.arange(len(size)), size)] = own[codes] if len(codes) else codes
        first = np.zeros(len(out), bool)
        first[starts[:-1] + np.arange(len(size))] = True
        return out, first


@dataclass
class Learnt:
    """What is learnt of a corpus: the model, its symbols, counts by bucket, the classes' mass, training tokens and distinct ones."""

    model: LogBilinear
    symbols: Symbols
    counts: DataFrame
    mass: np.ndarray
    tokens: int
    kinds: int


@dataclass
class _Score:
    """Finishes runs of documents; see fill_positions."""

    model: object
    table: object
    totals: tuple[int, int]
    class_mass: np.ndarray

    def prepare(self, items, values):
        """Symbol, log10 of the share in the symbol, and count of each code."""
        size, top = sum(map(len, items)), self.model.value.symbols - len(self.class_mass)
        symbol, count = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for codes, value in zip(items, values, strict=True):
            low, high, symbol[codes] = unpack(value).reshape(3, -1)
            count[codes] = low + (high << 32)
        mass = np.log10(self.class_mass)[np.maximum(symbol - top, 0)]
        return {"symbol": symbol, "share": np.where(symbol < top, 0.0, np.log10(count + 1.0) - mass), "c": count}

    def __call__(self, columns, ids, sizes, codes):
        m, z = self.model.value, self.table.value
        tokens, kinds = self.totals
        symbol, share, count = columns["symbol"][codes], columns["share"][codes], columns["c"][codes]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        first = np.zeros(len(codes), bool)
        first[starts[:-1]] = True  # every text has its end
        c = contexts_of(symbol, first, m.symbols)
        s = np.empty(len(codes))
        for at in range(0, len(codes), 1 << 16):
            p = slice(at, at + (1 << 16))
            q = m.far[c[p] // (m.symbols + 1)] + m.near[c[p] % (m.symbols + 1)]
            s[p] = np.einsum("ij,ij->i", q, m.target[symbol[p]]) + m.bias[symbol[p]]
        log10 = (s - z[c]) / np.log(10) + share
        base = np.log10((count + 1.0) / (tokens + kinds + 1.0))
        add = lambda x: np.add.reduceat(x, starts[:-1]) if len(x) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(add((count > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(log10))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def by_bucket(words: DataFrame, *order: str) -> DataFrame:
    """Rows dealt by bucket, those of a bucket together."""
    return words.repartition(tasks(words), "bucket").sortWithinPartitions("bucket", *order)


def word_counts(coded: DataFrame) -> DataFrame:
    """A written row for each bucket: its distinct words with their counts over all training documents, packed; and for each bin of classes with words there the counts' sum and number."""
    words = by_bucket(coded.filter("kind = 0").select((-1 - F.col("key")).cast("int").alias("bucket"), "words", "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, Counter()

        def row() -> pa.RecordBatch:
            c = np.fromiter(held.values(), np.int64, len(held))
            bins = np.fromiter((word_bin(w) for w in held), np.int64, len(held))
            n, v = np.bincount(bins, c, CLASS_BINS).astype(np.int64), np.bincount(bins[c > 0], minlength=CLASS_BINS)
            found = [{"bin": k, "n": n[k], "v": v[k]} for k in np.flatnonzero(v).tolist()]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.struct([("bin", pa.int32()), ("n", pa.int64()), ("v", pa.int64())]))]
            data = [[bucket], [pack_words(list(held))], [pack(np.concatenate((c & 0xFFFFFFFF, c >> 32)))], [found]]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(data, kinds, strict=True)], ["bucket", "words", "counts", "bins"])

        for batch in batches:
            for at, words, n in zip(*(batch.column(x).to_pylist() for x in ("bucket", "words", "n")), strict=True):
                if at != bucket:
                    if bucket is not None:
                        yield row()
                    bucket, held = at, Counter()
                for w, c in zip(unpack_words(words), unpack(n).tolist(), strict=True):
                    held[w] += c
        if bucket is not None:
            yield row()

    return materialize(words.mapInArrow(run, "bucket int, words binary, counts binary, bins array<struct<bin int, n long, v long>>"), "lz4")


def unpack_counts(words: bytes, counts: bytes) -> list[tuple[str, int]]:
    low, high = unpack(counts).reshape(2, -1)
    return list(zip(unpack_words(words), (low + (high << 32)).tolist(), strict=True))


def most_frequent(counts: DataFrame, n: int) -> list[tuple[str, int]]:
    """The n most frequent training tokens with their counts, ties by token: those of each bucket, then of all. n is bounded by MOST_SYMBOLS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, packed in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                best = heapq.nsmallest(n, ((-c, w) for w, c in unpack_counts(words, packed) if c))
                yield pa.RecordBatch.from_arrays([pa.array([w for _, w in best], pa.string()), pa.array([-c for c, _ in best], pa.int64())], ["word", "c"])

    if not n:
        return []
    found = counts.select("words", "counts").mapInArrow(run, "word string, c long").orderBy(F.desc("c"), "word").limit(n).agg(F.collect_list(F.struct("word", "c"))).first()[0]
    return sorted(((r.word, r.c) for r in found), key=lambda x: (-x[1], x[0]))


def word_values(coded: DataFrame, counts: DataFrame, symbols: Symbols) -> DataFrame:
    """chunk, items and value (counts' low and high halves, symbols) of all dictionary rows: each bucket's counts, then its rows of all chunks."""
    shared = coded.sparkSession.sparkContext.broadcast(symbols)
    rows = coded.filter("kind = 0").select((-1 - F.col("key")).cast("int").alias("bucket"), F.lit(1).alias("part"), "chunk", "items", "words", F.lit(None).cast("binary").alias("counts"))
    first = counts.select("bucket", F.lit(0).alias("part"), F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("items"), "words", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, known = shared.value, {}
        for batch in batches:
            chunk, items, values = [], [], []
            for part, c, i, words, data in zip(*(batch.column(x).to_pylist() for x in ("part", "chunk", "items", "words", "counts")), strict=True):
                if part == 0:
                    known = {w: (n, top.of(w)) for w, n in unpack_counts(words, data)}
                    continue
                found = np.array([known[w] for w in unpack_words(words)], np.int64)
                chunk.append(c)
                items.append(i)
                values.append(pack(np.concatenate((found[:, 0] & 0xFFFFFFFF, found[:, 0] >> 32, found[:, 1]))))
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(items, pa.binary()), pa.array(values, pa.binary())], ["chunk", "items", "value"])

    return by_bucket(first.unionByName(rows), "part").mapInArrow(run, "chunk long, items binary, value binary")


def learn(narrow: DataFrame, coded: DataFrame, most_symbols: int = MOST_SYMBOLS, group_tokens: int = GROUP_TOKENS) -> Learnt:
    """Counts, symbols and a trained model of the rows (doc_id, text) that aren't held out; coded: their words and counts, see code_documents."""
    counts = word_counts(coded)
    n, v = np.zeros(CLASS_BINS, np.int64), np.zeros(CLASS_BINS, np.int64)
    for r in counts.select(F.explode("bins").alias("b")).select("b.*").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # CLASS_BINS rows
        n[r.bin], v[r.bin] = r.n, r.v
    tokens, kinds = int(n.sum()), int(v.sum())
    wanted, classes = symbol_numbers(kinds, most_symbols)
    top = most_frequent(counts, wanted)
    for w, c in top:  # frequent tokens are symbols of their own
        n[word_bin(w)] -= c
        v[word_bin(w)] -= 1
    fold = lambda x: np.bincount(np.arange(CLASS_BINS) % classes, x, classes)
    symbols = Symbols({w: k for k, (w, _) in enumerate(top)}, classes)
    unigram = np.concatenate([np.array([c for _, c in top], float), fold(n)]) + 0.5
    unigram /= unigram.sum()
    model = untrained(unigram)
    groups = max(1, round(tokens / group_tokens))
    texts = grouped_symbols(narrow, symbols, groups)
    epochs = 1 if tokens >= FIT_TOKENS else min(MOST_EPOCHS, math.ceil(FIT_TOKENS / max(1, tokens)))
    for first, last in rounds(groups):
        model = one_round(texts.filter(F.col("group").between(first, last - 1)), model, unigram, first, last, epochs)
    return Learnt(model, symbols, counts, fold(n) + fold(v) + 1.0, tokens, kinds)


def rounds(groups: int) -> list[tuple[int, int]]:
    """Ranges of groups: the first round takes one, each ROUND_GROWTH times as many as the one before; what would not fill another round goes with the last."""
    out, at, width = [], 0, 1
    while at < groups:
        to = groups if groups - at - width < width * (ROUND_GROWTH if len(out) else 1) // 2 else at + width
        out.append((at, to))
        at, width = to, width * ROUND_GROWTH
    return out


def grouped_symbols(docs: DataFrame, symbols: Symbols, groups: int) -> DataFrame:
    """A written row for each training text: its group, its place in it, and its symbols. Both follow from a hash of id and text, whatever files or tasks the texts come from."""
    shared = docs.sparkSession.sparkContext.broadcast(symbols)
    kind = "<u2" if len(symbols.place) + symbols.classes < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found, first = shared.value.texts(part.column("text"))
                starts = np.append(np.flatnonzero(first), len(found)) * np.dtype(kind).itemsize
                data = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(found.astype(kind).tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("group"), part.column("place"), data], ["group", "place", "symbols"])

    place = F.xxhash64("doc_id", "text")
    texts = docs.filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    return materialize(texts.select("text", F.pmod(place, F.lit(groups)).cast("int").alias("group"), F.xxhash64("doc_id", "text", F.lit(1)).alias("place")).mapInArrow(run, "group int, place long, symbols binary"))


def one_round(texts: DataFrame, model: LogBilinear, unigram: np.ndarray, first: int, last: int, epochs: int) -> LogBilinear:
    """The model after a round: each group of texts goes on from it, in order of their places, and the groups' models are averaged by their tokens, part by part."""
    shared = texts.sparkSession.sparkContext.broadcast((model, unigram))
    kind = "<u2" if model.symbols < 1 << 16 else "<u4"
    ways = min(last - first, max(partitions(texts), 8))
    slabs = min(4096, ways)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, unigram = shared.value
        total, weight = 0.0, 0
        group, now, held, tokens, seen = None, common, [], 0, 0

        def fit() -> None:
            nonlocal now, held, tokens, seen
            if tokens:
                starts = np.zeros(tokens, bool)
                starts[np.cumsum([0, *map(len, held[:-1])])] = True
                now = train(np.concatenate(held).astype(np.int64), starts, unigram, now, seed=(group << 24) + seen // FIT_TOKENS, epochs=epochs)
                held, tokens, seen = [], 0, seen + tokens

        def close() -> None:
            nonlocal total, weight, now, seen
            fit()
            if seen:
                total, weight = total + now.flat().astype(float) * seen, weight + seen
            now, seen = common, 0

        for batch in batches:
            for new, data in zip(batch.column("group").to_pylist(), batch.column("symbols").to_pylist(), strict=True):
                if new != group:
                    close()
                    group = new
                held.append(np.frombuffer(data, kind))
                tokens += len(held[-1])
                if tokens >= FIT_TOKENS:
                    fit()
        close()
        if weight:
            parts = np.array_split((total / weight).astype("<f4"), slabs)
            yield pa.RecordBatch.from_arrays([pa.array(range(slabs), pa.int32()), pa.array([float(weight)] * slabs), pa.array([x.tobytes() for x in parts], pa.binary())], ["slab", "n", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for slab, n, part in zip(*(batch.column(c).to_pylist() for c in ("slab", "n", "part")), strict=True):
                x = total.setdefault(slab, [0.0, 0.0])
                x[0] += n
                x[1] = x[1] + np.frombuffer(part, "<f4").astype(float) * n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([(x / n).astype("<f4").tobytes() for n, x in total.values()], pa.binary())], ["slab", "part"])

    dealt = texts.repartitionById(ways, F.pmod(F.col("group") - first, F.lit(ways)).cast("int")).sortWithinPartitions("group", "place")
    parts = dealt.mapInArrow(run, "slab int, n double, part binary").repartition(slabs, "slab").sortWithinPartitions("slab", "n", F.xxhash64("part"))
    averaged = sorted(parts.mapInArrow(add, "slab int, part binary").collect())  # the model, in `slabs` rows
    return model.filled(np.concatenate([np.frombuffer(x.part, "<f4") for x in averaged])) if averaged else model


def normaliser_table(spark: SparkSession, shared, contexts: int, tasks: int) -> np.ndarray:
    """The normaliser of every context: (symbols + 1)^2 numbers, which the parameter most_symbols bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[0])]), pa.array([shared.value.normalisers(ids).astype("<f4").tobytes()], pa.binary())], ["first", "z"])

    found = sorted(spark.range(0, contexts, 1, tasks).mapInArrow(run, "first long, z binary").collect())
    return np.concatenate([np.frombuffer(x.z, "<f4") for x in found])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most_symbols: int = MOST_SYMBOLS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, both log10 of the text's probability.

    A null or empty text is its end token alone. Repeated rows count each time. With no training document, every token is unseen: counts are 0
    and symbols equally likely. most_symbols bounds the table of all pairs of symbols, which is broadcast: 4 bytes for each. An empty table gives an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    coded = materialize(code_documents(narrow.withColumn("counted", ~held_out(F.col("doc_id"))), fold=True, end=True, counted="counted"), "lz4")
    learnt = learn(narrow, coded, most_symbols, group_tokens)
    shared = spark.sparkContext.broadcast(learnt.model)
    table = normaliser_table(spark, shared, (learnt.model.symbols + 1) ** 2, max(48, learnt.model.symbols // 16))
    id_type = dict(coded.dtypes)["ids"].removeprefix("array<")[:-1]
    score = _Score(shared, spark.sparkContext.broadcast(table), (learnt.tokens, learnt.kinds), learnt.mass)
    out = fill_positions(coded.filter("kind = 1"), word_values(coded, learnt.counts, learnt.symbols), score, f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(learnt.tokens).cast("long").alias("train_tokens"), "base_score", "score")
