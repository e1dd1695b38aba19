"""Summaries of hierarchies: each member's text is summarised, a cluster's summaries are combined and summarised again, and so on up to the roots.

No text but the members' own is longer than a cluster's largest number of members times a summary. Any summariser of a column will do (see providers); `central` is one without a model: it keeps the sentences that are most
like all others, by the cosine of their words' counts, in their order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.common import written
from graphloom.functions.text import PART_BREAK, ordered_text
from graphloom.operators.chunk import sentences
from graphloom.operators.cluster import MOST_TEXT

#: Characters of a summary at most.
SUMMARY_LENGTH = 500
WORD = re.compile(r"\w+")


def central_sentences(text: str, most: int = SUMMARY_LENGTH) -> str:
    """The sentences most similar to all others, as many as fit `most` characters, in their order; of equal ones the first. Where none fits, the first is cut."""
    found = [x for x in sentences(text.strip()) if x]
    bags = [Counter(WORD.findall(x.lower())) for x in found]
    lengths = [sum(n * n for n in b.values()) ** 0.5 for b in bags]
    total: Counter = Counter()
    for bag, length in zip(bags, lengths, strict=True):
        for word, n in bag.items():
            total[word] += n / length
    # the mean cosine with all: a product with the sum of the unit vectors, so that no pair is made
    score = [sum(n * total[w] for w, n in b.items()) / length if length else 0.0 for b, length in zip(bags, lengths, strict=True)]
    kept, size = [], -1
    for k in sorted(range(len(found)), key=lambda k: (-round(score[k], 9), k)):
        if size + len(found[k]) + 1 <= most:
            kept.append(k)
            size += len(found[k]) + 1
    return " ".join(found[k] for k in sorted(kept)) if kept else (found[0][:most] if found else "")


def central(text: Column, most: int = SUMMARY_LENGTH) -> Column:
    """central_sentences() of a column of texts; null for null. Texts become Python objects one at a time, however long those of a batch are together."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array((None if not x.is_valid else central_sentences(x.as_py(), most) for x in texts), pa.string())

    return F.arrow_udf(run, T.StringType())(text)


def tree_summaries(tree: DataFrame, rows: DataFrame, summarize: Callable[[Column], Column] = central, id_col: str = "node_id", content: str = "content", most_text: int | None = MOST_TEXT) -> DataFrame:
    """group, cluster_id, depth and summary of each cluster of a hierarchy. rows: the members' texts, of which the first most_text characters are read, or all. Null texts are left out; members without any give an empty summary."""
    text = F.col(content) if most_text is None else F.left(F.col(content), F.lit(most_text))
    own = rows.select(F.col(id_col).cast("string").alias("member"), summarize(text).alias("text"))
    lowest = tree.filter("depth = 0").select("group", "cluster_id", "depth", "parent_id", F.explode("members").alias("member"))
    combined = lowest.join(own, "member").groupBy("group", "cluster_id", "depth", "parent_id").agg(ordered_text(F.col("member"), F.col("text"), PART_BREAK).alias("text"))
    level = written(combined.select("group", "cluster_id", "depth", "parent_id", summarize(F.col("text")).alias("summary")))
    out = level
    above = tree.select("group", "cluster_id", "depth", "parent_id")
    while True:
        joined = level.filter("parent_id is not null").select(F.col("parent_id").alias("cluster_id"), F.col("cluster_id").alias("child"), "summary").join(above, "cluster_id")
        combined = joined.groupBy("group", "cluster_id", "depth", "parent_id").agg(ordered_text(F.col("child"), F.col("summary"), PART_BREAK).alias("text"))
        level = written(combined.select("group", "cluster_id", "depth", "parent_id", summarize(F.col("text")).alias("summary")))
        if level.isEmpty():
            return out.select("group", "cluster_id", "depth", "summary")
        out = out.unionByName(level)
