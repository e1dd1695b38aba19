"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(s - t_k): all ordered thresholds t_1 < t_2 < ... share the weights behind the score s, the sum of the weights of a text's
features over its distinct words. Features are hashed lower-cased words and their first four to six letters, which catch inflected forms. The expected severity is the sum of P(grade > k).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import materialize, slices, split_words

DIMENSIONS = 1 << 20
PREFIXES = (4, 5, 6)
#: Labelled rows that the model is fitted on at most; which, a hash of the id decides.
SAMPLE_ROWS = 12_000
#: Features that are kept: in so many labelled texts at least, and so many standard errors apart between toxic and other texts.
LEAST_TEXTS, LEAST_Z = 2, 3.0
#: Probability of any toxicity from which a text counts as toxic: toxic texts are about a tenth, so that a half would miss those with one marker word.
LIMIT = 0.3
#: Marker words seen in a toxic text from which its grade is 2 and 3; grade 1 needs none.
GRADE_STEPS = (3, 6)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) by row and k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -40, 40)))


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of distinct words, -1 where there is none: a column for the word, one for each prefix. And the words that become equal once cleaned."""
    clean = pc.ascii_lower(pc.utf8_trim(pc.utf8_lower(words), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”…"))
    kinds = clean.dictionary_encode()
    names = kinds.dictionary.to_pylist()
    h = xxhash.xxh32_intdigest
    rows = [(h(w) % DIMENSIONS, *(h("^" + w[:n]) % DIMENSIONS if len(w) >= n else -1 for n in PREFIXES)) if w else (-1,) * (1 + len(PREFIXES)) for w in names]
    return np.array(rows, np.int64).reshape(len(rows), 1 + len(PREFIXES)), kinds.indices.to_numpy(zero_copy_only=False)


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the distinct cleaned words of all texts, and the pairs (row, word) in order, each once."""
    codes, words, starts = split_words(texts)
    features, of = word_features(words)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    pairs = np.unique(rows * max(1, len(features)) + of[codes]) if len(codes) else np.zeros(0, np.int64)
    return features, pairs // max(1, len(features)), pairs % max(1, len(features))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """text and _label of the labelled rows that the model is fitted on, one for each id: of repeated ids the greatest label and the least text count."""
    sample = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    total = sample.count()
    share = int(min(1.0, SAMPLE_ROWS / max(1, total)) * 2**64) - 2**63  # as large a part of all hashes; a sort would send SAMPLE_ROWS of every partition to the driver
    sample = sample.filter(F.xxhash64("_id") <= min(share, 2**63 - 1)).limit(SAMPLE_ROWS)
    found = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).join(F.broadcast(sample), "_id")  # SAMPLE_ROWS narrow rows at most
    return found.groupBy("_id").agg(F.min("text").alias("text"), F.first("_label").alias("_label")).select("text", "_label")


def screened(sample: DataFrame) -> dict[int, float]:
    """Features that tell toxic texts from others, with the standard errors between their shares of the two. Counted on the executors; a row for each feature at most, and only those kept reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                toxic = part.column("_label").to_numpy() > 0
                features, row, word = distinct_words(part.column("text"))
                rows, flat = np.repeat(row, features.shape[1]), features[word].ravel()
                pairs = np.unique((rows * DIMENSIONS + flat)[flat >= 0])
                r, f = pairs // DIMENSIONS, pairs % DIMENSIONS
                yes, every = np.bincount(f[toxic[r]], minlength=DIMENSIONS), np.bincount(f, minlength=DIMENSIONS)
                there = np.flatnonzero(every)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(yes[there], toxic.sum())), pa.array(np.append(every[there], len(toxic)))], ["feature", "yes", "every"])

    counts = sample.mapInArrow(run, "feature long, yes long, every long").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("every").alias("every"))
    totals = materialize(counts)
    whole = totals.filter("feature = -1").collect()
    if not whole or not 0 < whole[0].yes < whole[0].every:
        return {}
    n1, n = whole[0].yes, whole[0].every
    p = (F.col("every") + 1) / (n + 2)
    z = (F.col("yes") / n1 - (F.col("every") - F.col("yes")) / (n - n1)) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / (n - n1)))
    kept = totals.filter(f"feature >= 0 and every >= {LEAST_TEXTS}").select("feature", z.alias("z")).filter(f"abs(z) >= {LEAST_Z}")
    return {r.feature: r.z for r in kept.collect()}  # DIMENSIONS rows at most, in practice some thousands


def sample_rows(sample: DataFrame, kept: dict[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, numbers of marker words, and the pairs (row, number of the feature among those kept, one for each distinct word) of the sample's texts."""
    names = np.array(sorted(kept), np.int64)
    marker = np.array([kept[int(x)] >= 2 * LEAST_Z for x in names], bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.full(DIMENSIONS + 1, -1)
        at[names] = np.arange(len(names))
        for batch in batches:
            for part in slices(batch):
                features, row, word = distinct_words(part.column("text"))
                own = np.where(features < 0, -1, at[features])
                marks = np.bincount(row[np.append(marker, False)[own[word, 0]]], minlength=part.num_rows)
                rows, flat = np.repeat(row, own.shape[1]), own[word].ravel()
                rows, flat = rows[flat >= 0], flat[flat >= 0]
                cuts = np.searchsorted(rows, np.arange(part.num_rows + 1))
                found = [flat[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_label"), pa.array(marks.astype(np.int64)), pa.array(found, pa.binary())], ["label", "marks", "features"])

    got = sample.mapInArrow(run, "label int, marks long, features binary").toArrow()
    features = [np.frombuffer(x.as_py(), "<i4") for x in got.column("features")]
    row = np.repeat(np.arange(len(features)), [len(x) for x in features]) if features else np.zeros(0, np.int64)
    return got.column("label").to_numpy(), got.column("marks").to_numpy(), row, np.concatenate(features) if features else np.zeros(0, np.int32)


def severity_grades(toxic: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Grades 0 to 3 from yes-or-no labels: a toxic text is graded by its number of marker words, those that are far more frequent in toxic texts.

    This is a default for tables that have no grades, and a function of the features; labels that are graded are taken as they are (see `ordered`)."""
    return np.where(toxic, 1 + sum((marks >= k).astype(int) for k in GRADE_STEPS), 0)


def fit(grades: np.ndarray, rows: np.ndarray, flat: np.ndarray, names: np.ndarray, l2: float = 1e-4, steps: int = 150) -> OrdinalModel:
    """Fits weights of the features `names` and thresholds by Adam on the whole sample. Without both a toxic and another text, all texts get severity 0."""
    weights = np.zeros(DIMENSIONS)
    levels = int(grades.max()) if len(grades) else 0
    if levels < 1 or not (grades == 0).any():
        return OrdinalModel(weights, np.full(max(1, levels), 40.0))
    n, k = len(grades), np.arange(levels)
    reached = (grades[:, None] > k).mean(0).clip(1e-4, 1 - 1e-4)
    x = np.concatenate([np.zeros(len(names)), [-np.log(reached[0] / (1 - reached[0]))], np.full(levels - 1, np.log(0.5))])  # first threshold, logs of the gaps
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, first, gaps = x[: len(names)], x[len(names)], np.exp(x[len(names) + 1 :])
        t = first + np.concatenate(([0], np.cumsum(gaps)))
        s = np.bincount(rows, w[flat], n)
        above = 1 / (1 + np.exp(-np.clip(s[:, None] - t, -40, 40)))
        edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], 1)
        p = np.maximum(edges[np.arange(n), grades] - edges[np.arange(n), grades + 1], 1e-9)
        slope = above * (1 - above)
        lower = np.where(grades > 0, slope[np.arange(n), np.maximum(grades - 1, 0)], 0)  # derivative of the upper edge
        upper = np.where(grades < levels, slope[np.arange(n), np.minimum(grades, levels - 1)], 0)
        ds = -(lower - upper) / p / n
        dt = np.bincount(np.maximum(grades - 1, 0), np.where(grades > 0, lower / p, 0), levels) / n - np.bincount(np.minimum(grades, levels - 1), np.where(grades < levels, upper / p, 0), levels) / n
        tail = np.cumsum(dt[::-1])[::-1]
        g = np.concatenate([np.bincount(flat, ds[rows], len(names)) + l2 * w, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights[names] = x[: len(names)]
    return OrdinalModel(weights, x[len(names)] + np.concatenate(([0], np.cumsum(np.exp(x[len(names) + 1 :])))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", ordered: bool = False, id_col: str = "doc_id", text: str = "text") -> OrdinalModel:
    """A model from labelled rows. `label` holds ordered grades from 0, or, unless `ordered`, 0 and 1, from which severity_grades makes grades. Null labels and ids don't count."""
    sample = materialize(labelled_sample(docs, labels, label, id_col, text))
    kept = screened(sample)
    labelled, marks, rows, flat = sample_rows(sample, kept)
    return fit(labelled if ordered else severity_grades(labelled > 0, marks), rows, flat, np.array(sorted(kept), np.int64))


def scored(docs: DataFrame, model: OrdinalModel, text: str = "text", limit: float = LIMIT, out: str = "_score") -> DataFrame:
    """All of docs' columns, and the struct `out`, a name that docs doesn't have: severity (expected grade), p_toxic (probability of any grade above 0) and toxic (whether that reaches limit).

    Null and empty texts have no features: they get the model's severity of an empty text. Repeated rows are scored each. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if out in docs.columns:
        raise ValueError(f"{out} is a column already")
    schema = T.StructType([*docs.schema, T.StructField(out, T.StructType.fromDDL("severity double, p_toxic double, toxic boolean"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = np.append(m.weights, 0.0)
        for batch in batches:
            for part in slices(batch, text):
                features, row, word = distinct_words(part.column(text))
                value = weights[features].sum(1)
                above = m.above(np.bincount(row, value[word], part.num_rows) if len(word) else np.zeros(part.num_rows))
                new = [pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= limit)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(new, ["severity", "p_toxic", "toxic"])], [*part.schema.names, out])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: float = LIMIT, ordered: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, severity, p_toxic and toxic for each row of docs, by a model fitted on the labelled ones.

    Null and empty texts get the severity of an empty text; repeated rows are scored each. Without both kinds of labels all texts get severity 0. An empty
    table gives an empty result. Columns besides id and text aren't read, so their names don't matter.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    found = scored(narrow, fit_toxicity(docs, labels, label, ordered, id_col, text), limit=limit)
    return found.select("doc_id", F.round("_score.severity", 6).alias("severity"), F.round("_score.p_toxic", 6).alias("p_toxic"), "_score.toxic")
