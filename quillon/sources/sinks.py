"""Writers: files with a fixed layout, manifests, switched views and batch sinks."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillon.sources.readers import file_digests


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """K1: CSV with a header and exactly these columns in order."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """K2, K4: JSON lines, replacing what is there; with ``order`` the files are sorted as a whole.

    The new files are written beside the old ones and take their place only when all are there, so a failed write leaves the old ones as they are, and the table may be read while it is rewritten.
    """
    fresh = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    (df.orderBy(*order) if order else df).write.json(fresh)
    sc = df.sparkSession.sparkContext
    at = lambda p: sc._jvm.org.apache.hadoop.fs.Path(p)
    where = at(fresh).getFileSystem(sc._jsc.hadoopConfiguration())  # the file system that Spark itself uses for the path
    old = where.exists(at(path))
    if old and not where.rename(at(path), at(f"{fresh}.old")) or not where.rename(at(fresh), at(path)):
        raise OSError(f"cannot replace {path}; the new files are in {fresh}")
    if old:
        where.delete(at(f"{fresh}.old"), True)


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """K3: one JSON array if the path ends in ``.json`` (for small results), else JSON lines."""
    if path.endswith(".json"):
        rows = df.orderBy(key).select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator()
        with open(path, "w", encoding="utf-8") as f:
            f.write("[")
            for i, r in enumerate(rows):
                f.write((",\n" if i else "\n") + r["j"])
            f.write("\n]\n")
    else:
        write_jsonl(df, path)


def append_log(df: DataFrame, path: str) -> None:
    """JSON lines appended with the time of writing (UTC)."""
    df.withColumn("timestamp_utc", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("append").json(path)


def write_manifest(spark: SparkSession, folder: str, path: str, version: str) -> None:
    """The digests of a folder's files as a manifest."""
    assets = [r.asDict() for r in file_digests(spark, folder).orderBy("file").toLocalIterator()]
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump({"version": version, "assets": assets}, f, indent=1)
    os.replace(path + ".tmp", path)


def switch_view(spark: SparkSession, alias: str, target: str, least: int = 1) -> bool:
    """Points the view ``alias`` at the table ``target`` if that holds at least ``least`` rows; says whether it did. The view is one of the catalog, so all its sessions see the switch; only over a temporary view it is temporary."""
    if spark.table(target).limit(least).count() < least:
        return False
    kind = "TEMPORARY VIEW" if spark.catalog.getTable(target).isTemporary else "VIEW"
    spark.sql(f"CREATE OR REPLACE {kind} {alias} AS SELECT * FROM {target}")
    return True


def recreate_table(spark: SparkSession, name: str, schema: str, partition: list[str] = ()) -> None:
    """Drops a table of the catalog and creates it empty with exactly this schema."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = spark.createDataFrame([], schema).write.format("parquet")
    (writer.partitionBy(*partition) if partition else writer).saveAsTable(name)


def send_batches(df: DataFrame, key: str, send: Callable[[list[dict]], list[str | None]], size: int = 500) -> DataFrame:
    """Hands rows in batches to ``send`` on the executors, which answers with an error or None for each row: ``(n_rows, n_failed, first_key, first_error)`` per batch.

    A batch that raises counts as failed as a whole. Rows carry their ``key``, by which the receiver overwrites, so a batch that a lost task sends again changes nothing. The rows are sent when the result is written or counted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            records = pdf.to_dict("records")
            for at in range(0, len(records), size):
                batch = records[at : at + size]
                try:
                    said = send(batch)
                except Exception as e:  # noqa: BLE001
                    said = [str(e)] * len(batch)
                wrong = [(str(r[key]), e) for r, e in zip(batch, said) if e is not None]
                yield pd.DataFrame([(len(batch), len(wrong), *(wrong[0] if wrong else (None, None)))], columns=["n_rows", "n_failed", "first_key", "first_error"])

    return df.mapInPandas(run, "n_rows long, n_failed long, first_key string, first_error string")


def write_batches(df: DataFrame, send: Callable[[list[dict]], None], size: int = 500) -> None:
    """Hands rows in batches to ``send`` on the executors; a failed batch fails its task, which is tried again."""

    def run(rows: Iterator[Row]) -> None:
        batch: list[dict] = []
        for r in rows:
            batch.append(r.asDict(recursive=True))
            if len(batch) >= size:
                send(batch)
                batch = []
        if batch:
            send(batch)

    df.foreachPartition(run)


def write_report(tables: dict[str, DataFrame], path: str, title: str, most: int = 30) -> None:
    """Small aggregates as a Markdown report, the first ``most`` rows of each."""
    lines = [f"# {title}", ""]
    for name, df in tables.items():
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join(str(v) for v in r) + " |" for r in df.limit(most).toLocalIterator()] + [""]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines))
