"""Queries by name, each with the SQL that an independent engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from . import analysis_queries, literature_queries, ontology_queries, sequence_queries, source_queries, variant_queries  # noqa: F401
