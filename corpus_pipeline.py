"""From raw documents to training tokens: five stages, each applied to all rows that the one before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Extra columns of docs pass through the first
four stages, whatever their names. An empty table passes through as one. Nulls in other columns than text and doc_id change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import encode_documents
from graphloom.llm.common import materialize, row_key, unused
from graphloom.llm.decontamination import contained_items
from graphloom.llm.ngram_join import near_duplicates
from graphloom.llm.secrets import redacted_documents
from graphloom.llm.toxicity import fit_toxicity, scored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the ordinal model, fitted on the labelled ones, finds toxic. Null and empty texts get the verdict of a text without words; repeated rows stay or go together. Without labels, or with
    labels of one kind, nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = unused(docs, "_score")
    return scored(docs, fit_toxicity(docs, labels), out=score).filter(~F.col(score)["toxic"]).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of linked documents, the one with the least id (nulls last); of rows that agree in id and text, one. Null and empty texts are copies of
    each other, so one of them stays."""
    found = near_duplicates(docs).filter("kept").groupBy("k1", "k2").agg(F.count("*").alias("_copies"))
    kept = materialize(found, "lz4")
    a, b = unused(docs, "_k1"), unused(docs, "_k2")
    keyed = docs.withColumns(dict(zip((a, b), row_key("doc_id", "text"), strict=True)))
    one = keyed.join(kept.select(F.col("k1").alias(a), F.col("k2").alias(b)), [a, b], "left_semi")
    if not kept.filter("_copies > 1").isEmpty():
        one = one.dropDuplicates([a, b])
    return one.drop(a, b)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts hold none, null and empty items are held by none; without items nothing goes. Repeated rows stay or go together."""
    items = unused(docs, "_items")
    return contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=items).filter(F.size(items) == 0).drop(items)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the text, and counts n_chars anew where it did. No document is dropped: null texts stay null, repeated rows are redacted each."""
    return redacted_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of ids and decoded text of each document. Null and empty texts have no ids; repeated rows are encoded each."""
    return encode_documents(docs, with_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("bpe", encode)]

#: SQL has no BPE, ordinal regression or tokenizer ratio: the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage keeps is written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
