"""Closed integer intervals per entity: merging into continuous periods and listing the gaps.

The merge is Spark's own ``session_window`` with a duration that differs per row: the closed span ``[a, b]`` becomes a
session that starts at second ``a`` and lasts ``b - a + 1`` seconds, so overlapping and nested spans fall into one session.
Sessions that only touch (the next begins where the last ends) are joined afterwards, and gaps come from ``lead``.

Before the shuffle the spans of an entity are reduced to one row per start (the farthest end), so an entity holds at most
as many rows as it has distinct starts, however many rows it has in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_spans(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Longest runs of covered numbers: one row ``(*keys, span_from, span_to)`` per run.

    Spans are closed. Reversed ends cover the same numbers. Rows with a NULL end of either side are left out; NULL keys form
    an entity of their own. Repeated rows and extra columns have no effect; an empty table gives no rows.
    """
    a, b = F.col(f"`{start}`").cast("long"), F.col(f"`{end}`").cast("long")
    named = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    k = [f"k{i}" for i in range(len(keys))]
    spans = df.where(a.isNotNull() & b.isNotNull()).select(*named, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    farthest = spans.groupBy(*k, "a").agg(F.max("b").alias("b"))
    session = F.session_window(F.timestamp_seconds("a"), F.concat((F.col("b") - F.col("a") + 1).cast("string"), F.lit(" seconds")))
    merged = farthest.groupBy(*k, session.alias("w")).agg(F.min("a").alias("a"), F.max("b").alias("b")).select(*k, "a", "b")
    order = Window.partitionBy(*k).orderBy("a")
    opens = F.coalesce((F.lag("b").over(order) < F.col("a") - 1).cast("long"), F.lit(1))
    runs = merged.withColumn("o", opens).withColumn("run", F.sum("o").over(order))
    out = runs.groupBy(*k, "run").agg(F.min("a").alias("span_from"), F.max("b").alias("span_to"))
    return out.select(*[F.col(x).alias(n) for x, n in zip(k, keys)], "span_from", "span_to")


def span_gaps(periods: DataFrame, keys: list[str]) -> DataFrame:
    """The uncovered runs between two periods of one entity, in the columns of :func:`merge_spans`."""
    order = Window.partitionBy(*[F.col(f"`{x}`") for x in keys]).orderBy("span_from")
    nxt = F.lead("span_from").over(order)
    return (
        periods.withColumn("_next", nxt)
        .where(F.col("_next").isNotNull())
        .select(*[F.col(f"`{x}`") for x in keys], (F.col("span_to") + 1).alias("span_from"), (F.col("_next") - 1).alias("span_to"))
    )


def coverage(df: DataFrame, keys: list[str], start: str, end: str, kind: str = "span_kind") -> DataFrame:
    """Periods and gaps in one table, told apart by ``kind`` ('period' or 'gap').

    Both kinds come from one pass: each period row also yields the gap that follows it.
    """
    periods = merge_spans(df, keys, start, end)
    order = Window.partitionBy(*[F.col(f"`{x}`") for x in keys]).orderBy("span_from")
    both = periods.withColumn("_next", F.lead("span_from").over(order)).withColumn(
        "_row",
        F.explode(
            F.array_compact(
                F.array(
                    _piece("period", F.col("span_from"), F.col("span_to")),
                    F.when(F.col("_next").isNotNull(), _piece("gap", F.col("span_to") + 1, F.col("_next") - 1)),
                )
            )
        ),
    )
    return both.select(*[F.col(f"`{x}`") for x in keys], F.col("_row.kind").alias(kind), F.col("_row.a").alias("span_from"), F.col("_row.b").alias("span_to"))


def _piece(kind: str, a: Column, b: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
