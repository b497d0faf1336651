"""The query registry: each query is a function of a table accessor, with its oracle SQL if there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillon.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class Tables:
    """The tables of a data folder: t("orders")."""

    spark: SparkSession
    sf_dir: str

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def values(self, names: str, rows: str) -> DataFrame:
        """A literal table: names and a VALUES list."""
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS v({names})")


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with the SQL that DuckDB checks it by."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries named {key}")
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add
