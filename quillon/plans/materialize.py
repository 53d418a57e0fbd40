"""Cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs in one process (a local test session) a temporary folder is set; on a cluster a folder of one machine would lose what is cut, so that is an error.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if known is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            known = tempfile.mkdtemp(prefix="quillon-ckpt-")
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and returns a DataFrame that reads it back."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sorted_join(df: DataFrame) -> DataFrame:
    """``df`` for a join whose sides are shuffled and sorted, whatever size the optimizer expects.

    Its estimate takes a generator's rows for as many as it was given and a file for what it is compressed, so the tokens or n-grams of a table of a few MB pass as small enough to be broadcast and go through the driver as a whole.
    """
    return df.hint("merge")


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """The rows for which ``condition`` holds, where the condition uses columns that are costly to compute.

    A plain filter is pushed below the projection that computes its columns, so they are computed twice or more. Here a generator stands in between, and filters on what a generator makes stay above it.
    """
    return df.withColumn("_keep", F.explode_outer(F.when(condition, F.array(F.lit(True))))).where("_keep IS NOT NULL").drop("_keep")


def exploded(df: DataFrame, keep: list, items: Column, name: str, position: str | None = None) -> DataFrame:
    """``keep`` and one row per element of ``items``; unlike ``explode``, which has the optimizer test the array's size below it, the array is computed once. Elements are not NULL."""
    rows = df.select(*keep, (F.posexplode_outer(items).alias(position, name) if position else F.explode_outer(items).alias(name)))
    return rows.where(F.col(name).isNotNull())
