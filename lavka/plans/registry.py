"""Where the query modules put their queries and comparison statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lavka.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(statement: str | None = None, *needs: str):
    """Register a function under its own name, with its SQL where there is one."""

    def register(make):
        QUERIES[make.__name__] = make
        if statement:
            ORACLE[make.__name__] = views.sql(statement, *needs) if needs else statement
        return make

    return register
