"""The queries op1 to op10 and pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op8_substrings import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"))


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op9_resampling import importance

    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .op10_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op1_pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op2_language import identify

    return identify(table(spark, sf_dir, "documents"))


def op3_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op3_decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op4_jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op5_toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op6_secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op7_quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_language, op3_leaks, op4_jaccard, op5_toxicity, op6_secrets, op7_quality_rules, op8_substrings, op9_importance, op10_byte_bpe, pipeline)}


def oracle_sql() -> dict[str, str]:
    from . import op7_quality, op8_substrings

    return {"op7_quality_rules": op7_quality.oracle(), "op8_substrings": op8_substrings.oracle()}
