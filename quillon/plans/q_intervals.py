"""Interval queries over the verse spans of commentary sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import intervals
from quillon.sources.tables import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Covered stretches and the gaps between them for each work and chapter."""
    rows = intervals.coverage(table(spark, root, "tafsir_sections"), ["work_id", "surah_no"], "ayah_start", "ayah_end")
    return rows.select("work_id", "surah_no", "span_kind", F.col("span_from").cast("int").alias("ayah_from"), F.col("span_to").cast("int").alias("ayah_to"))


_P3 = """
WITH s AS (
  SELECT work_id, surah_no, least(ayah_start, ayah_end) AS a, greatest(ayah_start, ayah_end) AS b
  FROM tafsir_sections WHERE ayah_start IS NOT NULL AND ayah_end IS NOT NULL
), m AS (
  SELECT *, max(b) OVER (PARTITION BY work_id, surah_no ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s
), g AS (
  SELECT *, sum(CASE WHEN far IS NULL OR a > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY work_id, surah_no ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m
), p AS (
  SELECT work_id, surah_no, min(a) AS a, max(b) AS b FROM g GROUP BY work_id, surah_no, run
), q AS (
  SELECT *, lead(a) OVER (PARTITION BY work_id, surah_no ORDER BY a) AS nxt FROM p
)
SELECT work_id, surah_no, 'period' AS span_kind, CAST(a AS INTEGER) AS ayah_from, CAST(b AS INTEGER) AS ayah_to FROM q
UNION ALL
SELECT work_id, surah_no, 'gap', CAST(b + 1 AS INTEGER), CAST(nxt - 1 AS INTEGER) FROM q WHERE nxt IS NOT NULL
"""

QUERIES = {"p3_found": p3_found}
ORACLES = {"p3_found": _P3}
