"""Named queries over the landed tables, each with its SQL counterpart if it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(prepare(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def landing(folder: str, name: str) -> str:
    """The same place as a pattern: a file stream takes no single file."""
    return table(folder, name) + "*"
