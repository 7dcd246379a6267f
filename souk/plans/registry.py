"""Registry of driver-facing queries and their DuckDB oracle SQL.

A query is a callable ``(spark, sf_dir) -> DataFrame`` reading the driver
tables through :class:`souk.sources.Tables`; its oracle (when the result is
expressible in SQL) is DuckDB SQL over the same derived views.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from ..sources import Tables, duckdb_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Fixed parameters of the registered queries (the driver data has orders up
# to 2001-08-01, so rows after the clock exist on purpose).
AS_OF = dt.date(2001, 6, 30)
DAYS = 30


def d(offset_days: int = 0) -> str:
    """SQL DATE literal ``AS_OF + offset_days``."""
    return f"DATE '{(AS_OF + dt.timedelta(days=offset_days)).isoformat()}'"


def ts(offset_days: int = 0) -> str:
    """SQL TIMESTAMP literal at midnight of ``AS_OF + offset_days``."""
    return f"TIMESTAMP '{(AS_OF + dt.timedelta(days=offset_days)).isoformat()} 00:00:00'"


def query(name: str, views: list[str] | None = None, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``.

    ``views`` lists the entity views the oracle ``sql`` reads; they are
    prepended as CTEs.  Without ``sql`` the key gets the rows-only check.
    """
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(Tables(spark, sf_dir))
        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = duckdb_with(views or [], sql.strip())
        return fn
    return deco
