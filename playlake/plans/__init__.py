"""Registered queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _parts():
    from playlake.plans import fold_queries, image_queries, oracles, queries, scoring_queries

    return (queries.QUERIES, oracles.SQL), (image_queries.QUERIES, image_queries.SQL), (scoring_queries.QUERIES, scoring_queries.SQL), (fold_queries.QUERIES, fold_queries.SQL)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query by name."""
    return {name: q for part, _ in _parts() for name, q in part.items()}


def all_sql() -> dict[str, str]:
    """The DuckDB equivalent of every query that has one."""
    return {name: q for _, part in _parts() for name, q in part.items()}
