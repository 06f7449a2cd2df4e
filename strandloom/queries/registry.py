"""Registration of queries with their SQL, and the views over the given tables that both start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def oracle(body: str, *views: str) -> str:
    """body with the views as CTEs before it; body is a select, or more CTEs and a select, after the word recursive if one of them is."""
    ctes = ", ".join(f"{v} as ({tables.SQL[v]})" for v in views if v in tables.SQL)
    body = body.strip()
    plain = body.lower().startswith("select")
    start = "with recursive " if body.startswith("recursive ") else "with "
    body = body.removeprefix("recursive ")
    if not ctes:
        return body if plain else f"{start}{body}"
    return f"{start}{ctes}" + (" " if plain else ", ") + body


def query(name: str, *views: str, sql: str | None = None):
    """Registers f(*views as DataFrames), under name; sql names the views."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(tables.view(spark, sf_dir, v) for v in views))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = oracle(sql, *views)
        return f

    return register
