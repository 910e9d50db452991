"""Registry of named driver queries: a Spark builder and, where SQL can say it, a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None
    operators: str


_QUERIES: dict[str, Query] = {}


def register(name: str, operators: str, oracle: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: Builder) -> Builder:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        _QUERIES[name] = Query(name, fn, oracle, operators)
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from dialframe.plans import dialogue_queries, stats_queries, prompt_queries, vote_queries, file_queries  # noqa: F401
    return dict(_QUERIES)
