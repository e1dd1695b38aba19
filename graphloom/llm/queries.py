"""The registered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("host").alias("source"), "n_shout_words", "host_docs", "host_failed", F.round("host_rate", 9).alias("host_rate"), "host_blocked")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), window=400, with_kept=False)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.sharding import shard_rows

    return shard_rows(table(spark, sf_dir, "documents"), shards=8)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.secrets import scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"), with_redacted=False)
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", *(count(k) for k in ("assign", "access", "hex", "inefficient")), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.recompression import remove_repeated_words

    return remove_repeated_words(table(spark, sf_dir, "documents"), window=35, with_kept=False)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8).select("doc_id", "class_id", "n_links", "kept")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.conversations import damaged, report

    rows = table(spark, sf_dir, "conversations")
    return report(damaged(rows), conversations=rows)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"), most=8)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"), least=40, most_docs=5).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from graphloom.llm.sql import ORACLES

    return dict(ORACLES)
