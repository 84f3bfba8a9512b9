"""Registered queries: one per operator, each over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under the name of its function."""
    QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    from sparkwarden.plans import (  # noqa: F401
        queries_decisions,
        queries_evidence,
        queries_files,
        queries_names,
        queries_sinks,
        queries_traces,
    )

    return dict(QUERIES)
