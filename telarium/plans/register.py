"""A registry of queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from telarium.sources.telemetry import DUCKDB_US, TELEMETRY_SQL

Query = Callable[[SparkSession, str], DataFrame]

#: A common table expression with the typed telemetry, for the SQL twins.
TEL = f"tel AS ({TELEMETRY_SQL.format(us=DUCKDB_US)})"


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        self.queries[name] = query
        if sql is not None:
            self.oracle[name] = sql

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def note(f: Query) -> Query:
            self.add(name or f.__name__, f, sql)
            return f

        return note
