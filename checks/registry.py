"""Registration of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import Spark, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, **views: str):
    """Register ``fn(views: Spark) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Spark], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Spark(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = sql(oracle, **views)
        return fn

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded (and negative zero removed) so that both engines agree."""
    for c in columns:
        df = df.withColumn(c, F.round(c, digits) + F.lit(0.0))
    return df


def r6(expression: str) -> str:
    """SQL text that rounds like :func:`rounded`."""
    return f"round({expression}, 6) + 0.0"


def day_text(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd"))
    return df


def exploded_vector(df: DataFrame, vec: str, *keys: str) -> DataFrame:
    """Vector columns as (keys, dim, value) rows."""
    rows = df.select(*keys, F.posexplode(vec).alias("dim", "value"))
    return rounded(rows, "value")
