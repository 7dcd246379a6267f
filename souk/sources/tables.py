"""Loading the driver tables and the entity views built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS, dependencies


class Tables:
    """Lazy access to ``{sf_dir}/{name}.parquet`` tables and their entity views.

    Each table is read once per instance; views are defined with ``spark.sql``
    over those DataFrames (no global temp views are left behind), so Catalyst
    prunes columns and pushes filters from the operators down to the scans.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def view(self, name: str) -> DataFrame:
        if name in self._cache:
            return self._cache[name]
        deps = {d: (self.view(d) if d in VIEWS else self.raw(d)) for d in dependencies(name)}
        sql = VIEWS[name].replace("{TS}", "TIMESTAMP_NTZ")
        df = self.spark.sql(sql, **deps)
        self._cache[name] = df
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("v_") and name in VIEWS:
            return self.view(name)
        raise AttributeError(name)
