"""The corpus pipeline: documents to packed training sequences.

STAGES lists (name, function) in order; a function takes (spark, docs, sf_dir) and
returns the DataFrame that the next one gets, written as Parquet and read again.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import linededup, neardup, packing, quality, secrets
from quillmill.llm.common import removed, shared_dir, table
from quillmill.llm.vocabularies import byte_level, byte_level_added


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), quality.RiskConfig(joint=True))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the first of them; documents that this empties go."""
    return linededup.without_repeats(docs, linededup.new_index(docs, batches=2), drop_emptied=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets."""
    return secrets.redact(docs, rules=secrets.WHOLE_RULES)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its place in a sequence."""
    return packing.best_fit_sequences(docs, byte_level(), added=byte_level_added())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express weighted sampling or the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's files go when the next one's are there."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return docs
