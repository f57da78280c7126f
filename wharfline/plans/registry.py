"""A query is a name, the operators it covers, a function and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if f.__name__ in CATALOG:
            raise ValueError(f"{f.__name__} is registered twice")
        CATALOG[f.__name__] = Query(f.__name__, covers, f, sql)
        return f

    return keep
