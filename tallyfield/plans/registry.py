"""Where queries are registered beside the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (t, spark) -> DataFrame, t being a loader of tables, under its name; sql is its equivalent for DuckDB."""

    def add(f):
        from tallyfield.session import prepare, table

        def run(spark, sf_dir):
            prepare(spark)
            return f(lambda name: table(spark, sf_dir, name), spark)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
