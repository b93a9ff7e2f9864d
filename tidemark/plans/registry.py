"""Where queries and their SQL equivalents are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.views import with_views

#: Cutoffs that the queries use.
AS_OF, KNOWN_AT, DAY = "1997-06-30", "1997-08-31", "1996-03-15"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")
