"""Writers. Whatever the reference stored in one file per run is a folder here."""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import exists


def chapter_texts(chapters: DataFrame, path: str) -> None:
    """Bodies by author; partition folders stand for the tree of text files down to the author. A folder for each work would be a file or more for each, however small."""
    chapters.select("author_slug", "work_slug", "chapter_num", "body").write.mode("overwrite").partitionBy("author_slug").parquet(path)


def json_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def append_new(rows: DataFrame, path: str, keys: list[str], schema: str) -> None:
    """Append the rows whose key isn't there yet, of equal keys one; running it again adds nothing."""
    spark, rows = rows.sparkSession, rows.dropDuplicates(keys)
    if exists(spark, path):
        rows = rows.join(spark.read.schema(schema).json(path).select(*keys).distinct(), keys, "left_anti")
    rows.write.mode("append").json(path)


def document(row: DataFrame, path: str) -> None:
    """A frame of one row as one JSON document."""
    row.select(F.to_json(F.struct(*row.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def training_set(rows: DataFrame, path: str, meta: dict | None = None) -> None:
    """Packed rows by split, gzip, and beside them one row of metadata."""
    rows.write.mode("overwrite").partitionBy("split").option("compression", "gzip").parquet(path)
    if meta is not None:
        run_config(rows.sparkSession, meta, f"{path.rstrip('/')}.meta")


def run_config(spark: SparkSession, config, path: str) -> None:
    """A dataclass or dict as one JSON row."""
    value = json.dumps(asdict(config) if is_dataclass(config) else config, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def model(fitted, path: str) -> None:
    """A fitted ML pipeline."""
    fitted.write().overwrite().save(path)
