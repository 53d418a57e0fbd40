"""Joining ranked lists, choosing the best of several, and gated selection with reasons."""

from __future__ import annotations

import bisect
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.retrieval import overlap_coefficient, saturate
from quillon.plans.materialize import sorted_join


def reciprocal_rank_fusion(lanes: list[DataFrame], query: list[str], key: str, rank: str = "rank", k: int = 60) -> DataFrame:
    """``sum(1 / (k + rank))`` over the lanes: ``(*query, key, score, first_lane, n_lanes)``; ranks start at 1, ties go by key."""
    rows = reduce(DataFrame.unionByName, [d.select(*query, key, F.col(rank).alias("_r"), F.lit(i).alias("_lane")) for i, d in enumerate(lanes)])
    return rows.groupBy(*query, key).agg(F.round(F.sum(1.0 / (k + F.col("_r"))), 9).alias("score"), F.min("_lane").alias("first_lane"), F.count("*").alias("n_lanes"))


def with_rank(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """Adds ``rank`` within ``by``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: list[str], k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows per group; the order should end in a unique column."""
    return with_rank(df, by, *order).where(F.col("rank") <= k)


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row per key, the first by the order."""
    return top_k(df, keys, 1, *order).drop("rank")


def supplement(strict: DataFrame, relaxed: DataFrame, query: list[str], key: str, enough: int) -> DataFrame:
    """Rows of the relaxed lane are added, without those of the strict one, for queries whose strict lane has fewer than ``enough`` rows. Column ``lane`` tells them apart."""
    n = strict.groupBy(*query).agg(F.count("*").alias("_n"))
    more = relaxed.join(strict.select(*query, key), [*query, key], "left_anti").join(n, query, "left").where(F.coalesce("_n", F.lit(0)) < enough).drop("_n")
    return strict.withColumn("lane", F.lit("strict")).unionByName(more.withColumn("lane", F.lit("relaxed")))


def blend_with_provider(heuristic: Column, provider: Column, query: list[str], weight: float = 0.45) -> Column:
    """A heuristic score blended with a provider's, which is divided by its maximum over the query's candidates; without one the heuristic stays."""
    most = F.max(provider).over(Window.partitionBy(*query))
    share = F.when(most > 1e-9, provider / most).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(most.isNull(), heuristic).otherwise((1 - weight) * heuristic + weight * share))), 4)


# Weights of the rerank score, by name of its term.
RERANK = {"chapter": 0.24, "summary": 0.16, "text": 0.10, "central": 0.16, "answer": 0.18, "topic": 0.18, "terms": 0.12, "miss": -0.12, "incidental": -0.12, "narrative": -0.10}


def rerank_score(query_tokens: Column, fields: dict[str, Column], signals: dict[str, Column], bonus: Column | None = None) -> Column:
    """Weighted overlaps of the query with the fields plus weighted signals plus a bonus, between 0 and 1. Missing signals count as 0."""
    parts = [RERANK[n] * overlap_coefficient(query_tokens, c) for n, c in fields.items()] + [RERANK[n] * F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in signals.items()]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(parts, bonus if bonus is not None else F.lit(0.0))))


# Weights of the selection score for ordinary queries and for queries about events and practices.
SELECT = {"lexical": 0.16, "semantic": 0.18, "central": 0.26, "answer": 0.22, "builder": 0.08, "incidental": -0.10, "narrative": -0.04}
SELECT_NARRATIVE = {"lexical": 0.20, "semantic": 0.18, "central": 0.28, "answer": 0.20, "builder": 0.04, "incidental": -0.06, "narrative": -0.02}
ALIGNED = 0.08


def selection_score(signals: dict[str, Column], aligned: Column, narrative: bool = False, bonus: Column | None = None) -> Column:
    """The weighted signals; ``lexical`` and ``semantic`` are saturated first."""
    weights = SELECT_NARRATIVE if narrative else SELECT
    parts = [w * (saturate(signals[n]) if n in ("lexical", "semantic") else F.coalesce(signals[n].cast("double"), F.lit(0.0))) for n, w in weights.items() if n in signals]
    return sum(parts, F.when(aligned, ALIGNED).otherwise(0.0) + (bonus if bonus is not None else F.lit(0.0)))


def gated_selection(df: DataFrame, query: list[str], key: str, score: str, gates: list[tuple[str, Column]], k: int) -> DataFrame:
    """Every candidate with the reason of its rejection or its rank among the accepted.

    ``gates`` are ``(reason, rejects)`` in order; the first that rejects gives the reason. Repeated keys of a query are rejected as ``duplicate``, accepted ones beyond ``k`` as ``beyond_limit``.
    """
    reason = F.lit(None).cast("string")
    for name, rejects in reversed(gates):
        reason = F.when(rejects, name).otherwise(reason)
    copy = F.row_number().over(Window.partitionBy(*query, key).orderBy(F.col(score).desc())) > 1
    rows = df.withColumn("_copy", copy).withColumn("reason", F.when(F.col("_copy"), "duplicate").otherwise(reason)).drop("_copy")
    order = Window.partitionBy(*query, F.col("reason").isNull()).orderBy(F.col(score).desc(), key)
    rows = rows.withColumn("rank", F.when(F.col("reason").isNull(), F.row_number().over(order)))
    return rows.withColumn("reason", F.when(F.col("rank") > k, "beyond_limit").otherwise(F.col("reason"))).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))


def with_abstention(queries: DataFrame, selected: DataFrame, query: list[str]) -> DataFrame:
    """One row per query with the number of accepted rows and whether it abstains."""
    n = selected.where("rank IS NOT NULL").groupBy(*query).agg(F.count("*").alias("n_selected"))
    out = queries.select(*query).distinct().join(n, query, "left").withColumn("n_selected", F.coalesce("n_selected", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n_selected") == 0, "abstain").otherwise("ok"))


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of one stretch that survive, without their ends."""
    pdf = pdf.sort_values("rank")
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for rank, a, b in pdf[["rank", "_a", "_b"]].itertuples(index=False, name=None):
        at = bisect.bisect_right(starts, b)
        if not at or ends[at - 1] < a:
            starts.insert(at, a)
            ends.insert(at, b)
            kept.append(rank)
    return pdf[pdf["rank"].isin(kept)].drop(columns=["_a", "_b"])


def suppress_overlaps(df: DataFrame, query: list[str], group: str, start: str, end: str, *order: Column | str, limit: int | None = None) -> DataFrame:
    """Per query the spans that survive when, in the given order, every span that overlaps an accepted one of its ``group`` is dropped; ``limit`` keeps the first survivors.

    Spans are closed. Only spans that are connected by overlaps can decide about each other, so each stretch of a group that spans cover without a break is worked on by itself (kept spans as a sorted list), and only
    ranks and ends go through Python. Spans with a NULL end are left out.
    """
    keys = list(dict.fromkeys([*query, group]))
    ranked = with_rank(df.where(F.col(start).isNotNull() & F.col(end).isNotNull()), query, *order)
    by = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = ranked.select(*keys, "rank", F.col(start).cast("long").alias("_a"), F.col(end).cast("long").alias("_b"), F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)).alias("_new"), start, end)
    spans = spans.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).select(*keys, "rank", "_a", "_b", "_island")
    kinds = ", ".join(f"`{c}` {spans.schema[c].dataType.simpleString()}" for c in [*keys, "rank", "_island"])
    kept = spans.groupBy(*keys, "_island").applyInPandas(_greedy, kinds).select(*query, "rank")
    out = ranked.join(sorted_join(kept), [*query, "rank"])
    return out if limit is None else top_k(out.withColumnRenamed("rank", "_r"), query, limit, "_r").drop("rank").withColumnRenamed("_r", "rank")
