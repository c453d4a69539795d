"""Registry of queries with their SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chalkline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Registers a function under its name; its argument gives the tables by name."""

        def keep(f):
            def run(spark: SparkSession, folder: str) -> DataFrame:
                return f(Tables(spark, folder))

            run.__doc__ = f.__doc__
            self.queries[f.__name__] = run
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep
