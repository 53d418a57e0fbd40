"""Merging batches into tables: upserts with outcomes, cascading deletes and JSON merges, as joins that return the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], fixed: list[str] = ()) -> DataFrame:
    """``new`` merged into ``old``: ``keys``, ``fields`` and ``outcome``.

    ``outcome`` is 'inserted', 'updated', 'unchanged' (same values) or 'kept' (not in the batch). Values are compared NULL-safe, and a new NULL overwrites. ``fixed`` fields keep their old value.
    Keys are unique on each side and match NULL-safe. One shuffle per side.
    """
    o = old.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.struct(*fields).alias("_old"), F.lit(True).alias("_in_old"))
    n = new.select(*[F.col(k).alias(f"n_{k}") for k in keys], F.struct(*fields).alias("_new"), F.lit(True).alias("_in_new"))
    cond = None
    for k in keys:
        same = F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}"))
        cond = same if cond is None else cond & same
    both = o.join(n, cond, "full_outer")
    compared = [f for f in fields if f not in fixed]
    differs = ~F.struct(*[F.col(f"_old.{f}") for f in compared]).eqNullSafe(F.struct(*[F.col(f"_new.{f}") for f in compared]))
    outcome = F.when(F.col("_in_new").isNull(), "kept").when(F.col("_in_old").isNull(), "inserted").when(differs, "updated").otherwise("unchanged")
    take = lambda f: F.when(F.col("_in_new").isNull() | (F.col("_in_old").isNotNull() & F.lit(f in fixed)), F.col(f"_old.{f}")).otherwise(F.col(f"_new.{f}"))
    key = lambda k: F.when(F.col("_in_new").isNull(), F.col(f"o_{k}")).otherwise(F.col(f"n_{k}"))
    return both.select(*[key(k).alias(k) for k in keys], *[take(f).alias(f) for f in fields], outcome.alias("outcome"))


def upsert_with_children(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], old_children: DataFrame, new_children: DataFrame, child_fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """K8: a merge of parents and of their children, one child per parent, keyed by the parent. Children of the batch whose parent is in neither table are left out."""
    parents = upsert(old, new, keys, fields)
    known = new_children.join(parents.select(*keys), keys, "left_semi")
    return parents, upsert(old_children, known, keys, child_fields)


def outcome_counts(merged: DataFrame) -> DataFrame:
    """How many rows had each outcome."""
    return merged.groupBy("outcome").agg(F.count("*").alias("n"))


def delete_cascade(parents: DataFrame, doomed: Column, parent_key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """The parents that stay and, for each child table ``name: (table, foreign key)``, the rows whose parent stays. NULL foreign keys stay."""
    gone = parents.where(doomed).select(F.col(parent_key).alias("_gone")).distinct()
    out = {"parents": parents.where(~doomed | doomed.isNull())}
    for name, (table, foreign) in children.items():
        out[name] = table.join(gone, F.col(foreign) == F.col("_gone"), "left_anti")
    return out


def merge_json(old: Column, new: Column) -> Column:
    """Flat JSON objects as one, keys of the new one winning; NULL counts as an empty object. Values are kept as text."""
    empty = F.create_map().cast("map<string,string>")
    parse = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), empty)
    o, n = parse(old), parse(new)
    return F.map_concat(F.map_filter(o, lambda k, v: ~F.map_contains_key(n, k)), n)


def with_default_ids(df: DataFrame, id_col: str, *parts: Column, sep: str = ":") -> DataFrame:
    """A blank or missing id is built from the parts."""
    return df.withColumn(id_col, F.coalesce(F.nullif(F.trim(F.col(id_col)), F.lit("")), F.concat_ws(sep, *[p.cast("string") for p in parts])))


def blank_to_null(df: DataFrame, *cols: str) -> DataFrame:
    """Blank texts as NULL."""
    return df.withColumns({c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in cols})


def run_totals(events: DataFrame, run: str, counters: list[str], status: str, at: str) -> DataFrame:
    """Audit runs from their events: summed counters and the last status."""
    return events.groupBy(run).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counters], F.max_by(status, at).alias(status), F.min(at).alias("opened_at"), F.max(at).alias("closed_at"))
