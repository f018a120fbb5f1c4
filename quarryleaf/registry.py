"""All registered queries and their SQL, by name. Plan modules register theirs with `query` when imported here."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows where SQL can."""

    def put(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


for module in ("counts", "windows", "authors", "joins", "text", "vectors", "statistics", "graphs", "reviews", "layers", "streams", "citations", "evaluation", "views", "curation", "provider", "runs"):
    import_module(f"quarryleaf.plans.{module}")
