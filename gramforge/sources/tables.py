"""Parquet tables of a directory, and the size of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a folder) of ``directory``."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle: the session's setting, but never below its cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
