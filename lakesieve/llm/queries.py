"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe_codec, embedding_dedup, hard_negatives, line_dedup, minhash_dedup, packing, quality_classifier, quality_rules, record_files, secret_scan, source_divergence, suffix_dedup, token_counts,
)
from .common import table


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files are; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score_documents(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later repeats of three lines and more, and of one or two lines that hold over 50 words."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), words=line_dedup.WORDS).select("doc_id", "text", "n_lines", "n_removed")


def op4_line_dedup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later repeats of three lines and more only."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.codec_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(quality_rules.quality_rules(table(spark, sf_dir, "documents")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files stay in the shared folder, next to the intermediate tables."""
    return record_files.record_digests(record_files.write_records(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_classifier, op2_suffix_dedup, op3_token_counts, op4_line_dedup, op4_line_dedup_runs, op5_minhash_dedup,
        op6_embedding_dedup, op7_secret_scan, op8_bpe_codec, op9_quality_rules, op10_packing, op11_hard_negatives, op12_record_files, op13_source_divergence,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": line_dedup.WORDS_ORACLE_SQL, "op4_line_dedup_runs": line_dedup.ORACLE_SQL, "op9_quality_rules": quality_rules.ORACLE_SQL,
        "op11_hard_negatives": hard_negatives.ORACLE_SQL, "op13_source_divergence": source_divergence.ORACLE_SQL,
    }
