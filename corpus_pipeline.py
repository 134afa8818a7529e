"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next stage's
documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import importance, near_copies, packing, secret_scan, suffix_dedup
from quillspark.llm.common import release, settled, table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling: documents that it does not select go."""
    return importance.keep_selected(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash with exact verification: one document of each group of near copies stays."""
    return near_copies.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that occur more than once are taken out of the texts."""
    return suffix_dedup.without_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secret_scan.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path(packing.VOCABULARY))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("secrets", secrets), ("pack", pack)]

#: SQL cannot express these stages; tests hold each one's rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, settled(lambda s=stage, d=docs: s(spark, d, sf_dir), f"stage-{name}")
        release(last)
    return STAGES[-1][1](spark, docs, sf_dir)
