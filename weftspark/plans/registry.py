"""A named collection of queries and the SQL of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            key = name or fn.__name__
            self.queries[key] = fn
            if sql:
                self.sql[key] = sql
            return fn

        return add

    def derived(self, name: str, table: str, keys: list[str], expressions: dict[str, str], sql: str, rounds: dict[str, int] | None = None) -> None:
        """A query that derives columns of a table and returns them with its keys."""
        from pyspark.sql import functions as F

        from weftspark.functions.derive import derive
        from weftspark.session import table as load

        def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = derive(load(spark, sf_dir, table), expressions)
            shown = [F.round(F.col(c), rounds[c]).alias(c) if rounds and c in rounds else F.col(c) for c in expressions]
            return out.select(*keys, *shown)

        self.queries[name] = fn
        self.sql[name] = sql
