"""Streams over chapters and briefs, for what the reference does by appending and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..functions.columns import once
from ..sources import readers


def manifest_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(readers.MANIFEST).json(path)


def new_rows(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key hasn't come before; the keys seen are the stream's state."""
    return stream.dropDuplicates(keys)


def append_sink(stream: DataFrame, path: str, checkpoint: str):
    """A query that appends JSON lines and resumes where it stopped."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def running_word_counts(stream: DataFrame, by: str = "author", text: str = "text") -> DataFrame:
    """(by, chapters, words), kept up to date as chapters come."""
    df = once(stream.select(by, text), n=F.size(T.words(F.col(text))))
    return df.groupBy(by).agg(F.count("*").alias("chapters"), F.sum("n").alias("words"))


def windowed_counts(events: DataFrame, by: str = "event_type", at: str = "ts", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts per time window, with a bound on how late rows may come."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), by).agg(F.count("*").alias("n")).select("w.start", "w.end", by, "n")


def upserted(batch: DataFrame, target: str, keys: list[str]) -> None:
    """For foreachBatch: append those rows of a batch whose key the target table doesn't hold."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(keys)
    if spark.catalog.tableExists(target):
        fresh = fresh.join(spark.table(target).select(*keys), keys, "left_anti")
    fresh.write.mode("append").saveAsTable(target)
