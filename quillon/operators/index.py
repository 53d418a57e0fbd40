"""Inverted indexes over tokens and q-grams, and inverse document frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.materialize import exploded


def postings(df: DataFrame, key: str, terms: Column, by: list[str] | None = None) -> DataFrame:
    """A3: one row per distinct term of a document with its frequency and the document's length: ``(by..., key, term, tf, doc_len)``.

    Terms are counted inside the row, as the runs of the sorted list, so nothing is shuffled and the work follows the length of the list. Documents without terms give no rows.
    """
    rows = df.select(*(by or []), key, F.array_sort(terms).alias("_s")).withColumn("_n", F.size("_s"))
    ends = F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: (i == F.col("_n") - 1) | (F.get("_s", i) != F.get("_s", i + 1)))
    rows = rows.select(*(by or []), key, "_s", "_n", F.when(F.col("_n") > 0, ends).alias("_e"))
    runs = F.transform("_e", lambda e, k: F.struct(F.get("_s", e).alias("term"), (e - F.coalesce(F.get("_e", k - 1), F.lit(-1))).alias("tf")))
    each = exploded(rows, [*(by or []), key, F.col("_n").alias("doc_len")], runs, "_x")
    return each.select(*(by or []), key, "_x.term", "_x.tf", "doc_len")


def document_frequency(df: DataFrame, terms: Column, by: list[str] | None = None) -> DataFrame:
    """A1, A2: in how many documents each term occurs; partial counts are made before the shuffle."""
    rows = exploded(df, list(by or []), F.array_distinct(terms), "term")
    return rows.groupBy(*(by or []), "term").agg(F.count("*").alias("df"))


def idf_bm25(n: Column, df: Column) -> Column:
    """``ln(1 + (n - df + 0.5) / (df + 0.5))``."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def idf_smooth(n: Column, df: Column) -> Column:
    """``ln((n + 1) / (df + 1)) + 1``."""
    return F.log((n + 1) / (df + 1)) + 1


def min_token_overlap(n: Column) -> Column:
    """How many query tokens a candidate must hold."""
    return F.when(n <= 2, 1).when(n <= 4, 2).when(n <= 8, 3).otherwise(4)


def min_qgram_overlap(n: Column) -> Column:
    """How many query q-grams a candidate must hold."""
    return F.when(n <= 0, 1).when(n <= 6, 2).when(n <= 14, 3).otherwise(4)


def distinctive_terms(df: DataFrame, bucket: list[str], family: list[str], key: str, terms: Column, top: int) -> DataFrame:
    """A5: per bucket the terms with the highest frequency times smooth idf of the bucket's family (ties: by term)."""
    n = df.groupBy(*family).agg(F.countDistinct(key).alias("_n"))
    freq = document_frequency(df, terms, family)
    tf = exploded(df, bucket, terms, "term").groupBy(*bucket, "term").agg(F.count("*").alias("tf"))
    scored = tf.join(freq, [*family, "term"]).join(n, family).withColumn("score", F.round(F.col("tf") * idf_smooth(F.col("_n"), F.col("df")), 6))
    order = Window.partitionBy(*bucket).orderBy(F.col("score").desc(), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*bucket, "term", "tf", "score", "rank")
