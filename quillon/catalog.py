"""Gathers the core queries and their SQL from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    from quillon.plans import q_enrich, q_files, q_intervals, q_quotes, q_relational, q_resolve, q_retrieval, q_rules, q_rules_sql, q_search, q_selection, q_small, q_spans, q_text

    return [q_retrieval, q_small, q_resolve, q_rules_sql, q_files, q_search, q_selection, q_enrich, q_text, q_spans, q_intervals, q_relational, q_rules, q_quotes]


def queries() -> dict[str, Query]:
    """All core queries by name."""
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The SQL of those core queries that SQL can express."""
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}
