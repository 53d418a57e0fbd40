"""Aggregates for reports and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclusive_quantiles(df: DataFrame, by: list[str], value: str, points: list[float]) -> DataFrame:
    """Quantiles by the exclusive method: the value at place ``p * (n + 1)``, interpolated, for each point; NULL values are left out.

    Values are counted first; running counts over the counted values, a window that sorts and spills, place the points. Nothing is gathered per group.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*by)
    placed = counted.withColumn("_k", F.sum("_c").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("_c").over(whole))
    places = {p: F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), p * (F.col("n") + 1))) for p in points}
    at = lambda i: F.max(F.when((F.col("_k") - F.col("_c") < i) & (F.col("_k") >= i), F.col(value).cast("double")))
    ends = [x for k, p in enumerate(points) for x in (at(F.floor(places[p])).alias(f"_lo{k}"), at(F.ceil(places[p])).alias(f"_hi{k}"))]
    out = placed.groupBy(*by).agg(F.max("n").alias("n"), *ends)
    between = lambda k, p: F.col(f"_lo{k}") + (places[p] - F.floor(places[p])) * (F.col(f"_hi{k}") - F.col(f"_lo{k}"))
    return out.select(*by, "n", *[F.round(between(k, p), 6).alias(f"q{round(100 * p)}") for k, p in enumerate(points)])


def bucket_counts(df: DataFrame, value: Column, edges: list[int], name: str = "bucket") -> DataFrame:
    """How many rows fall between the edges: ``1-3``, ``4-6``, ..., ``11+``; below the first edge is ``0``."""
    label = F.lit(f"{edges[-1]}+")
    for a, b in reversed(list(zip(edges, edges[1:]))):
        label = F.when(value < b, f"{a}-{b - 1}").otherwise(label)
    label = F.when(value < edges[0], "0").otherwise(label)
    return df.groupBy(F.when(value.isNotNull(), label).alias(name)).agg(F.count("*").alias("n"))


def rate(passed: Column, among: Column | None = None) -> Column:
    """Share of passed rows among those that count; 1.0 if none counts."""
    counts = among if among is not None else F.lit(True)
    return F.round(F.coalesce(F.avg(F.when(counts, F.coalesce(passed, F.lit(False)).cast("double"))), F.lit(1.0)), 6)


def gate(metrics: DataFrame, least: dict[str, float]) -> DataFrame:
    """The metrics with the names of those below their threshold and whether all pass."""
    failed = F.array_compact(F.array(*[F.when(F.col(m) < t, F.lit(m)) for m, t in least.items()]))
    return metrics.withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)


def preflight(df: DataFrame, present: list[str], flags: dict[str, Column]) -> DataFrame:
    """One row: number of rows, for each column how many rows have it, for each flag how many rows it holds for."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in present], *[F.count_if(c).alias(n) for n, c in flags.items()])


def hierarchy(df: DataFrame, levels: list[str], measures: list[Column]) -> DataFrame:
    """The measures at every level of a hierarchy and in total, in one pass; ``level`` is the depth (0 for the total)."""
    depth = sum((1 - F.grouping(c) for c in levels), F.lit(0)).cast("int")
    return df.rollup(*levels).agg(depth.alias("level"), *measures)


def unused(reference: DataFrame, key: str, used: DataFrame, used_key: str) -> DataFrame:
    """Keys of the reference that are never used."""
    return reference.select(key).distinct().join(used.select(F.col(used_key).alias(key)), key, "left_anti")


def unique_suffixes(df: DataFrame, name: str, sep: str = ".") -> DataFrame:
    """Suffixes of dotted names that belong to one name only, with that name."""
    parts = F.split(F.col(name), F.lit("\\" + sep))
    rows = df.select(name).distinct().select(name, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), sep))).alias("suffix"))
    out = rows.groupBy("suffix").agg(F.count("*").alias("n"), F.min(name).alias(name))
    return out.where("n = 1").select("suffix", name)


def phrase_specificity(df: DataFrame, leaf: str, phrases: str, weight: Column) -> DataFrame:
    """Per leaf and phrase the largest weight times ``max(1, leaves / leaves with the phrase)``."""
    rows = df.select(leaf, F.explode(phrases).alias("phrase"), weight.alias("_w"))
    freq = rows.groupBy("phrase").agg(F.countDistinct(leaf).alias("_f"))
    n = df.agg(F.countDistinct(leaf).alias("_n"))
    best = rows.groupBy(leaf, "phrase").agg(F.max("_w").alias("_w"))
    return best.join(freq, "phrase").crossJoin(F.broadcast(n)).select(leaf, "phrase", F.round(F.col("_w") * F.greatest(F.lit(1.0), F.col("_n") / F.col("_f")), 6).alias("weight"))


def issues(checks: dict[str, Column]) -> Column:
    """The names of the checks a row fails, in order. A check that is NULL counts as failed."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
