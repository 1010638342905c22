"""The registry of queries: each has a Spark function (spark, sf_dir) and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskline.fixtures import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables and views by attribute, for one session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(sql: str | None = None, views: str = "", more: str = ""):
    """Register a function of Tables. sql is the oracle's SELECT; views and more become its common table expressions."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            heads = ", ".join(x for x in (ctes(*views.split()), more) if x)
            ORACLES[f.__name__] = f"WITH {heads} {sql}" if heads else sql
        return f

    return register
