"""Named queries over the driver's tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "g1_hybrid"


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


from . import searches, texts  # noqa: E402, F401  they register themselves
