"""Readers. Schemas are given, never inferred."""

from __future__ import annotations

import os
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

CATALOG = "`Text#` string, Type string, Issued string, Title string, Language string, Authors string, Subjects string, LoCC string, Bookshelves string"
MANIFEST = "author string, cluster string, work_title string, work_slug string, pg_id string, chapter_num int, path string, words long, chars long"
BRIEFS = "chapter_path string, chunk_idx int, brief string, author string, cluster string"


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows in file order (position); fields may hold line breaks."""
    rows = spark.read.schema(CATALOG).csv(path, header=True, multiLine=True, escape='"', enforceSchema=True)
    return rows.withColumn("position", F.monotonically_increasing_id())


def cached_file(url: str, path: str, refresh: bool = False) -> str:
    """path, after downloading url into it unless it is there already. A source step of the driver: on a cluster path lies in a folder that all share."""
    target = Path(path)
    if refresh or not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(target.name + ".part")
        with urllib.request.urlopen(url, timeout=60) as body, part.open("wb") as out:  # noqa: S310
            while block := body.read(1 << 16):
                out.write(block)
        os.replace(part, target)
    return str(target)


def fetched_texts(rows: DataFrame, urls: str = "urls", seconds_between: float = 0.5) -> DataFrame:
    """rows with text: the first of the urls that answers with a body that passes the ingest test; null if none does."""
    from ..functions.constants import MARKER_NAME

    def run(batches):
        import time

        import pyarrow as pa

        def fetch(candidates):
            for url in candidates or ():
                time.sleep(seconds_between)
                try:
                    with urllib.request.urlopen(url, timeout=60) as r:  # noqa: S310
                        body = r.read().decode("utf-8", "replace") if r.status == 200 else ""
                except OSError:
                    continue
                if body and MARKER_NAME in body[:8000]:
                    return body
            return None

        for b in batches:
            yield b.append_column("text", pa.array([fetch(u) for u in b.column(b.schema.get_field_index(urls)).to_pylist()], pa.string()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, text string")


def manifest(spark: SparkSession, path: str, cluster: str | None = None) -> DataFrame:
    rows = spark.read.schema(MANIFEST).json(path)
    return rows if cluster is None else rows.where(F.col("cluster") == cluster)


def briefs(spark: SparkSession, path: str) -> DataFrame:
    """Briefs with the path as key; line tells later rows from earlier ones: by the time their file was written, then by their place in it."""
    rows = spark.read.schema(BRIEFS).json(path)
    line = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    return rows.select(F.col("chapter_path").alias("path"), "chunk_idx", "brief", "author", "cluster", line.alias("line"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), a row per file below path."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def training_set(spark: SparkSession, path: str, split: str | None = None, columns: tuple[str, ...] = ("*",)) -> DataFrame:
    from ..operators.dataset import training_split

    rows = spark.read.parquet(path)
    return (rows if split is None else training_split(rows, split)).select(*columns)
