"""Where this subpackage's queries and comparison statements are put."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(statement: str | None = None):
    """Register a function under its own name, with its SQL where there is one."""

    def register(make):
        QUERIES[make.__name__] = make
        if statement:
            ORACLE[make.__name__] = statement
        return make

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
