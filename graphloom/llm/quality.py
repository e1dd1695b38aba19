"""Quality rules by document and by host.

Each document is measured against fixed rules. Failures are added up by host (domain), and a host's rate is shrunk towards the rate of all hosts by
a beta prior fitted to the hosts themselves (method of moments), so that a host of few documents isn't condemned by chance. A host whose shrunk
rate reaches the limit is blocked, and its verdict is joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import U64, gram_hashes, hash_strings, materialize, mix, slices, split_words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shout_words")


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text, as int64; a null text counts as an empty one."""
    texts = pc.fill_null(texts, "")
    codes, words, starts = split_words(texts)
    rows = len(texts)
    size = np.diff(starts)
    row = np.repeat(np.arange(rows), size)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    shout = pc.and_(pc.equal(pc.utf8_upper(words), words), pc.match_substring_regex(words, r"\p{Lu}\P{Lu}*\p{Lu}")).to_numpy(zero_copy_only=False)
    total = lambda x: np.bincount(row, x[codes], rows).astype(np.int64) if len(codes) else np.zeros(rows, np.int64)

    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten().dictionary_encode()
    real = pc.match_substring_regex(flat.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(rows), np.diff(lines.offsets.to_numpy()))
    ids, of = ids[real[ids]], of[real[ids]]
    kinds = np.unique(of * (len(real) + 1) + ids) // (len(real) + 1)

    h = hash_strings(words)[codes] if len(words) else np.zeros(0, U64)
    grams = gram_hashes(h, WINDOW)
    whole = np.flatnonzero(row[: len(grams)] == row[WINDOW - 1 :]) if len(grams) else np.zeros(0, np.int64)
    keys = grams[whole] ^ mix(row[whole].astype(U64) + U64(1))
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    twice = whole[count[inverse] > 1]
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    return {
        "n_words": size, "word_chars": total(chars), "n_symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
        "n_dup_lines": np.bincount(of, minlength=rows) - np.bincount(kinds, minlength=rows), "n_repeat_words": np.bincount(row[covered], minlength=rows), "n_shout_words": total(shout.astype(np.int64)),
    }


def measured(docs: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Id, host and measures of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = measure(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(found[k], pa.int64()) for k in MEASURES)], ["doc_id", "host", *MEASURES])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    kinds = dict(source.dtypes)
    return source.mapInArrow(run, f"doc_id {kinds['doc_id']}, host {kinds['host']}, " + ", ".join(f"{k} long" for k in MEASURES))


def document_rules(rows: DataFrame) -> DataFrame:
    """base_failed by the two contract rules, rule_failed by all: they also ask for symbols in less than a tenth of the words' number, repeated
    lines in at most a third as many as words are in ten, words of 2 to 15 characters on average, and less than 30 % shouted words."""
    n = F.col("n_words")
    base = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    more = (10 * F.col("n_symbols") >= n) | (30 * F.col("n_dup_lines") > n) | (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n) | (10 * F.col("n_shout_words") >= 3 * n)
    return rows.withColumn("base_failed", base).withColumn("rule_failed", base | more)


def host_verdicts(rows: DataFrame, limit: float = 0.5) -> DataFrame:
    """Per host: documents, failures, the shrunk rate and whether it reaches the limit.

    The prior's mean m is the failures of all documents; its strength s comes from the variance v between host rates, weighted by documents and
    less what sampling alone gives: s = m (1 - m) / v - 1, held to 1 ... 1e6. One host, or hosts that don't differ, give the strongest prior.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("rule_failed").cast("long")).alias("host_failed"))
    n, k = F.col("host_docs"), F.col("host_failed")
    p = hosts.agg(F.sum(n).alias("n"), F.sum(k).alias("k"), F.count("*").alias("h"), F.sum(k * k / n).alias("q")).first()  # one row
    if not p.n:
        return hosts.select("host", "host_docs", "host_failed", F.lit(0.0).alias("host_rate"), F.lit(False).alias("host_blocked"))
    m = p.k / p.n
    between = p.q / p.n - m * m - m * (1 - m) * p.h / p.n
    s = max(1.0, min(1e6, m * (1 - m) / between - 1)) if between > 0 else 1e6
    rate = (k + m * s) / (n + s)
    return hosts.select("host", "host_docs", "host_failed", rate.alias("host_rate"), (rate >= limit).alias("host_blocked"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text", limit: float = 0.5) -> DataFrame:
    """One row for each row of docs: its measures, base_failed, the host's rate and verdict, and kept.

    kept is true if no rule fails the document and its host isn't blocked. Null and empty texts have no words and fail. Rows without a host form
    one host. Repeated rows count each time. An empty table gives an empty result. Columns besides id, host and text aren't read.
    """
    rows = materialize(document_rules(measured(docs, id_col, host, text)))
    # written, so that the join is between two exchanges and AQE can split a hot host; few hosts are broadcast by their written size
    hosts = materialize(host_verdicts(rows, limit)).withColumnRenamed("host", "_host")
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("rule_failed") & ~F.col("host_blocked"))
