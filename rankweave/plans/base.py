"""Registration of queries with their oracles, and small helpers that both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; sql may use the relations of ``fixtures.SQL`` (it is put in front)."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {fixtures.SQL}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().lstrip('+')}"
        return fn

    return add


def plain(name: str, sql: str | None = None):
    """Register a query whose oracle needs no fixture relation."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def r6(c: Column) -> Column:
    """Floats leave rounded, so that the order of a sum can't show."""
    return F.round(c, 6)
