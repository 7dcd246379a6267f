"""Date spine and period bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exprs import as_of_date


def period_start(as_of, days: int) -> Column:
    """First day of the trailing period of ``days`` days ending at ``as_of``."""
    return F.date_sub(as_of_date(as_of), days - 1)


def previous_start(as_of, days: int) -> Column:
    """First day of the period of ``days`` days before the current one."""
    return F.date_sub(as_of_date(as_of), 2 * days - 1)


def date_spine(spark: SparkSession, as_of, days: int) -> DataFrame:
    """One row per calendar day of the trailing period (``date``).

    A one-row range exploded by ``sequence``: at most ``days`` rows, so it is
    always safe to broadcast or to use as the preserved side of a join.
    """
    return (spark.range(1)
            .select(F.explode(F.sequence(period_start(as_of, days), as_of_date(as_of))).alias("date")))
