"""Queries with their SQL: a query's result is ints as they are and doubles rounded on both sides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 4


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    exact: tuple[str, ...]
    rounded: tuple[str, ...]
    sql: str | None
    digits: int = DIGITS

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        return df.select(*self.exact, *[(F.round(F.col(c).cast("double"), self.digits) + 0.0).alias(c) for c in self.rounded])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        columns = [*self.exact, *(f"round(CAST({c} AS DOUBLE), {self.digits}) + 0.0 AS {c}" for c in self.rounded)]
        head, _, body = self.sql.rpartition(" :: ")  # common tables, then the select
        return (f"WITH {head} " if head else "") + f"SELECT {', '.join(columns)} FROM ({body}) AS result"


class Registry:
    def __init__(self, digits: int = DIGITS) -> None:
        self.queries: dict[str, Query] = {}
        self.digits = digits

    def add(self, name: str, exact: str, rounded: str, sql: str | None, digits: int | None = None):
        """Registers the decorated function (spark, sf_dir) under a name."""

        def keep(f):
            self.queries[name] = Query(name, f, tuple(exact.split()), tuple(rounded.split()), sql, self.digits if digits is None else digits)
            return f

        return keep
