"""The registered queries of the ten operators and of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import annsearch, bpe, chunkdedup, langid, linededup, neardup, packing, quality, secrets, warc
from .common import table
from .oracles import ORACLES  # noqa: F401
from .vocabularies import byte_level, byte_level_added


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_held_out(table(spark, sf_dir, "documents"))


def op2_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkdedup.repeated_runs(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op4_secret_scan_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"), rules=secrets.WHOLE_RULES)


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annsearch.search_table(table(spark, sf_dir, "embeddings"))


def op6_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), *byte_level())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_sequences(table(spark, sf_dir, "documents"), byte_level(), added=byte_level_added())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality.RiskConfig(joint=True))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_mixture, op2_weighted_minhash, op3_chunk_dedup, op4_secret_scan, op4_secret_scan_whole, op5_cross_polytope, op6_tree_bpe, op7_line_dedup, op8_best_fit_packing, op9_quality_rules, op9_quality_rules_joint, op10_warc_revisits, pipeline)}

