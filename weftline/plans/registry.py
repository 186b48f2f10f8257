"""A query is a function of (spark, folder) with, where SQL can express it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries and their SQL twins."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.twins: dict[str, str] = {}

    def add(self, name: str, twin: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = query
            if twin is not None:
                self.twins[name] = twin
            return query

        return keep

    def merge(self, *others: Registry) -> Registry:
        for other in others:
            for name, query in other.queries.items():
                self.add(name, other.twins.get(name))(query)
        return self
