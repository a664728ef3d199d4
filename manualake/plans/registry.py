"""Queries with the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

Tables = Callable[[str], DataFrame]
#: White space of any kind, in DuckDB's regular expressions.
WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Registry:
    def __init__(self) -> None:
        self._queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self._sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
        """Registers a function of the tables under its name."""

        def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda name: table(spark, sf_dir, name))

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            self._queries[f.__name__] = run
            if sql:
                self._sql[f.__name__] = sql
            return f

        return add

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)
