"""A corpus pipeline of five stages; each takes the documents that its predecessor kept.

run() writes each stage's result as Parquet under spark.checkpoint.dir and reads it again, so a
lost executor repeats work of one stage at most. All stages but the last return the columns of
documents. ORACLE_SQL is None: the quality classifier and the tagger are not SQL; the tests hold
each stage against a plain version.

Null and empty texts: quality judges them by weight 0, near_duplicates and decontamination keep them, personal_data
leaves null null, tokens gives no ids. A null doc_id is kept as such; in near_duplicates it represents a group only where
nothing else is in it. Repeated rows are decided alike by quality; of linked ones near_duplicates keeps one. Ties: quality
keeps all at the cut, near_duplicates takes the least doc_id, then the text with the least hash. Empty tables give empty
tables; without labels of both kinds quality keeps everything, without items decontamination does. Further columns, whatever
their names, pass through all stages but the last, which returns doc_id, the ids and their digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import shared_dir, table
from veilmark.llm.op1_pii import redact
from veilmark.llm.op3_decontamination import without_leaks
from veilmark.llm.op4_jaccard import representatives
from veilmark.llm.op9_resampling import resampled
from veilmark.llm.op10_bpe import encode_documents

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that importance resampling rejects."""
    return resampled(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones."""
    return representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return encode_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, full=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = shared_dir(spark)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
