"""A small registry: a decorated function is a query, its SQL stands beside it."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def register(function):
            self.queries[function.__name__] = function
            if sql:
                self.sql[function.__name__] = sql
            return function

        return register


def read(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
