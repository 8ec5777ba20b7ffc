"""Registry of driver queries: a Spark callable and, where SQL can state it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, names, digits: int = 6) -> DataFrame:
    """Values rounded for comparison; adding 0 turns -0 into 0."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) + F.lit(0.0) for n in names})


def session_with(spark: SparkSession, **settings: str) -> SparkSession:
    """A session of the same application with its settings and a few more, so that the given one keeps its own."""
    own = spark.newSession()
    for k, v in {**spark.conf.getAll, **settings}.items():
        if own.conf.isModifiable(k):
            try:
                own.conf.set(k, v)
            except PySparkException:  # a value that only a new application takes
                if k in settings:
                    raise
    return own
