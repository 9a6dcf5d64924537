"""Where queries are registered with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, and DuckDB's SQL for those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"{key} is registered twice")
            self.queries[key] = f
            if sql is not None:
                self.oracles[key] = sql
            return f

        return add
