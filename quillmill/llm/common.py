"""Shared plumbing of the corpus operators: tables, checkpoints, Arrow helpers."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import removed, saved, shared_dir, stored  # noqa: F401
from ..sources.tables import table  # noqa: F401


def released(spark: SparkSession) -> None:
    """Lets shuffle files and checkpoints of finished steps go.

    Spark deletes them when the driver collects what refers to them, and a driver with
    memory to spare may not do so before the disks are full.
    """
    gc.collect()
    spark._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't have."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"__{n}"
        while n.lower() in have:
            n += "_"
        out.append(n)
    return out


def filled_text(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
