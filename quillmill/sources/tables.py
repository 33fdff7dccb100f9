"""Reading a driver table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Above this size there are files enough, and their list isn't asked for.
SMALL_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if it is small and has fewer files than there are cores.

    A file of one row group is read by one task, whatever its size on disk; on a
    small input that task would do all the work on its texts alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
