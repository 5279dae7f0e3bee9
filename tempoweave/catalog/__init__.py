"""Named queries by family, each with its DuckDB statement where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries and statements of a family."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.statements: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.statements[f.__name__] = sql
            return f

        return add
