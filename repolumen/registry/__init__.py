"""Queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


def load_all() -> None:
    """Import the modules that register queries."""
    from repolumen.registry import (  # noqa: F401
        corpus_queries,
        embed_queries,
        fetch_queries,
        origin_queries,
        search_queries,
        stream_queries,
    )
