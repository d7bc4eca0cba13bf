"""Registry of named queries: a Spark DataFrame builder plus its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
HEADLINE: list[str] = []


def register(name: str, sql: str | None = None, headline: bool = False):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str, database: str | None = None) -> DataFrame:
            return fn(Tables(spark, sf_dir, database))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def round_half_away(c, places: int = 6):
    """Round half away from zero with explicit IEEE steps (scale, +0.5,
    floor, unscale), so Spark and the SQL oracle round identically; a
    library ``round`` differs between engines on ties such as 0.3193125.
    Infinities and NaN pass through; the result is never -0.0."""
    m = float(10 ** places)
    pos = F.floor(c * m + 0.5) / m
    neg = (F.lit(0) - F.floor(F.lit(0.0) - c * m + 0.5)) / m
    return (F.when(F.isnan(c) | (F.abs(c) == float("inf")), c)
            .when(c < 0, neg).otherwise(pos))


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (engines sum in different orders)."""
    return df.select(*[round_half_away(F.col(f.name), places).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])
