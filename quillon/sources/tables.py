"""Parquet table access by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root`` (one file or a folder of files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def text_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Like :func:`table`, for costly work on texts: an input of fewer partitions than there are cores is spread over the cores.

    That happens only to inputs of a few files, so what it moves is bounded by cores times the split size; larger inputs are read as they are split.
    """
    df = table(spark, root, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
