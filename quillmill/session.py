"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """The running session, or a new one: adaptive execution with split of skewed joins, UTC, Arrow."""
    builder = SparkSession.builder.appName("quillmill")
    builder = builder.master(master) if master else builder
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    conf |= {"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}
    return builder.config(map=conf | settings).getOrCreate()
